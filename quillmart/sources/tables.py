"""Readers and writers of catalogs, registries, exports, match candidates and snapshots; blocked responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from quillmart.functions.text import clean_text, parse_bool, parse_krw_price, parse_number, parse_options, parse_whole_number

#: The columns of a source record; only ``source`` is required.
_TEXT, _NUMBER, _WHOLE, _TEXTS = StringType(), DoubleType(), IntegerType(), ArrayType(StringType())
RECORD_SCHEMA = StructType([
    *(StructField(n, _TEXT) for n in ("canonical_product_id", "category", "source_brand_name", "source_brand_name_en", "product_name_ko", "product_name_en", "product_name_display_ko", "product_name_display_en")),
    *(StructField(n, _NUMBER) for n in ("regular_price", "original_price", "sale_price")),
    StructField("discount_rate", _WHOLE),
    StructField("rating", _NUMBER),
    StructField("review_count", _WHOLE),
    *(StructField(n, _TEXT) for n in ("currency", "shade", "image_url", "description")),
    StructField("options", _TEXTS),
    StructField("search_keywords", _TEXTS),
    StructField("sold_out", BooleanType()),
    StructField("source", _TEXT, False),
    *(StructField(n, _TEXT) for n in ("source_url", "source_product_id", "updated_at")),
])
#: Columns of a product export, codes and marks of blocked responses.
EXPORT_COLUMNS = ("product_id", "product_name", "brand_name", "category", "price", "discount_price", "rating", "review_count", "image_url", "product_url", "description", "options", "sold_out", "source", "updated_at")
BLOCKED_STATUS = (403, 429, 503)
BLOCKED_MARKS = ("cf_chl", "cf-chl", "cloudflare", "enable javascript and cookies", "captcha", "bot detection", "잠시만 기다려 주세요", "자동화된 요청")


def assert_record_schema(df: DataFrame) -> DataFrame:
    """The frame with exactly the record columns in their types, missing ones null; an error without ``source``."""
    if "source" not in df.columns:
        raise ValueError("records need a source")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA))


def read_catalog(spark: SparkSession, path: str, source: str = "verified") -> DataFrame:
    """Records of catalog files ``{"products": [...]}``: ``goods_no`` is the product id, ``keywords`` the search keywords, prices are in KRW unless said."""
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in RECORD_SCHEMA if f.name not in ("source_product_id", "search_keywords"))
    extra = "goods_no: string, source_product_id: string, keywords: array<string>, search_keywords: array<string>, brand_ko: string, brand_en: string, price: double"
    rows = spark.read.schema(f"products array<struct<{fields}, {extra}>>").json(path, multiLine=True).select(F.explode("products").alias("p")).select("p.*")
    rows = rows.withColumns({
        "source_product_id": F.coalesce("source_product_id", "goods_no"), "search_keywords": F.coalesce("search_keywords", "keywords"), "source": F.coalesce("source", F.lit(source)), "currency": F.coalesce("currency", F.lit("KRW")),
        "source_brand_name": F.coalesce("source_brand_name", "brand_ko"), "source_brand_name_en": F.coalesce("source_brand_name_en", "brand_en"), "regular_price": F.coalesce("regular_price", "price"),
    })
    return assert_record_schema(rows)


def read_brand_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(official_en, alias, position)`` of registry files, in file order; :func:`normalize.alias_table` makes the dimension."""
    rows = spark.read.schema("entries array<struct<official_en: string, aliases: array<string>, sources: array<string>>>").json(path, multiLine=True)
    entries = rows.select(F.posexplode("entries").alias("entry", "e"))
    listed = entries.select("entry", F.col("e.official_en").alias("official_en"), F.posexplode(F.concat(F.coalesce("e.aliases", F.array().cast("array<string>")), F.array("e.official_en"))).alias("no", "alias"))
    return listed.where(clean_text(F.col("official_en")).isNotNull() & clean_text(F.col("alias")).isNotNull()).select("official_en", "alias", (F.col("entry") * 10_000 + F.col("no")).alias("position"))


def read_expansions(spark: SparkSession, synonyms: str, intents: str) -> DataFrame:
    """``(kind, entry, terms)`` of a synonym file (key to terms) and an intent file (name to labels and terms)."""
    one = spark.read.text(synonyms, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("entry", "terms"))
    two = spark.read.text(intents, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<labels: array<string>, terms: array<string>>>")).alias("name", "i"))
    labels = two.select(F.explode(F.coalesce("i.labels", F.array("name"))).alias("entry"), F.col("i.terms").alias("terms"))
    return one.select(F.lit("synonym").alias("kind"), "entry", "terms").unionByName(labels.select(F.lit("intent").alias("kind"), "entry", "terms"))


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of product exports. A discount price is a sale price where it differs from the price."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in EXPORT_COLUMNS)).csv(path, header=True, escape='"', multiLine=True)
    price, discount = parse_krw_price(F.col("price")), parse_krw_price(F.col("discount_price"))
    return assert_record_schema(rows.select(
        clean_text(F.col("category")).alias("category"), clean_text(F.col("brand_name")).alias("source_brand_name"), clean_text(F.col("product_name")).alias("product_name_ko"),
        price.alias("regular_price"), price.alias("original_price"), F.when(~discount.eqNullSafe(price), discount).alias("sale_price"), parse_number(F.col("rating")).alias("rating"),
        parse_whole_number(F.col("review_count")).alias("review_count"), clean_text(F.col("image_url")).alias("image_url"), clean_text(F.col("description")).alias("description"),
        parse_options(F.col("options")).alias("options"), parse_bool(F.col("sold_out")).alias("sold_out"), F.coalesce(clean_text(F.col("source")), F.lit("unknown")).alias("source"),
        clean_text(F.col("product_url")).alias("source_url"), clean_text(F.col("product_id")).alias("source_product_id"), clean_text(F.col("updated_at")).alias("updated_at"),
    ))


def write_products_csv(records: DataFrame, path: str) -> int:
    """Write records as product exports, options as JSON, and return how many."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = records.select(
        F.col("source_product_id").alias("product_id"), F.col("product_name_ko").alias("product_name"), F.col("source_brand_name").alias("brand_name"), "category", F.col("regular_price").alias("price"),
        F.col("sale_price").alias("discount_price"), "rating", "review_count", "image_url", F.col("source_url").alias("product_url"), "description",
        F.when(F.size("options") > 0, F.to_json("options")).alias("options"), F.col("sold_out").cast("string").alias("sold_out"), "source", "updated_at",
    )
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.csv(path, header=True, escape='"', mode="overwrite")
    return seen.get["n"]


#: The fields of a match candidate, the first of which are required.
CANDIDATE_FIELDS = ("canonical_product_id", "source", "source_product_id", "source_url", "match_method", "confidence", "original_price", "sale_price", "currency", "image_url", "sold_out", "evidence_note")
REQUIRED_FIELDS = CANDIDATE_FIELDS[:6]


def read_match_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` and the fields (as texts) of match-candidate files, CSV or JSON lines by the path's ending.

    A line is the row's number in its file: of CSV with the header as row 1, of JSON lines with empty lines counted and
    left out. Lines of a file are numbered block by block, each block by its own rows, so no task sees a whole file.
    A line that isn't a JSON object has nulls in all fields.
    """
    schema = ", ".join(f"{n} string" for n in CANDIDATE_FIELDS)
    as_json = path.endswith((".jsonl", ".ndjson", ".json"))
    raw = spark.read.text(path) if as_json else spark.read.schema(schema).csv(path, header=True, escape='"', enforceSchema=False)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    block = Window.partitionBy("file", "__block")
    sizes = rows.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("n"))  # a row for each block of each file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("__no", F.row_number().over(block.orderBy("__at"))).join(sizes.select("file", "__block", before.alias("__before")), ["file", "__block"])
    line = (F.col("__before") + F.col("__no") + (0 if as_json else 1)).alias("line")
    if not as_json:
        return numbered.select("file", line, *CANDIDATE_FIELDS)
    return numbered.where(F.trim("value") != "").select("file", line, F.from_json("value", schema).alias("r")).select("file", "line", "r.*")


def candidate_reason(row: dict[str, Column] | None = None) -> Column:
    """Why a match candidate isn't valid: a required field is missing or blank, the URL isn't one, the confidence is no
    number or not within 0 and 1. Null for a valid one."""
    c = row or {n: F.col(n) for n in REQUIRED_FIELDS}
    number = c["confidence"].try_cast("double")
    url = F.trim(c["source_url"])
    missing = F.coalesce(*(F.when(F.trim(F.coalesce(c[n], F.lit(""))) == "", f"missing required field: {n}") for n in REQUIRED_FIELDS))
    return (
        F.when(missing.isNotNull(), missing)
        .when(~url.rlike("^https?://"), F.concat(F.lit("source_url does not look like a URL: '"), url, F.lit("'")))
        .when(number.isNull(), F.concat(F.lit("confidence is not a number: '"), c["confidence"], F.lit("'")))
        .when(~number.between(0, 1) | F.isnan(number), F.concat(F.lit("confidence out of range [0.0, 1.0]: "), number.cast("string")))
    )


def split_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, invalid)``: valid rows with trimmed texts and typed prices, confidence and stock; invalid ones as they are,
    with ``reason``. A price that is no number, or a stock word that isn't known, is null."""
    judged = rows.withColumn("reason", candidate_reason())
    texts = {n: F.trim(n) for n in REQUIRED_FIELDS[:5]} | {n: F.nullif(F.trim(n), F.lit("")) for n in ("currency", "image_url", "evidence_note") if n in rows.columns}
    numbers = {n: F.col(n).try_cast("double") for n in ("confidence", "original_price", "sale_price") if n in rows.columns}
    word = F.lower(F.trim("sold_out"))
    stock = {"sold_out": F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)} if "sold_out" in rows.columns else {}
    return judged.where(F.col("reason").isNull()).drop("reason").withColumns(texts | numbers | stock), judged.where(F.col("reason").isNotNull())


def write_targets(targets: DataFrame, path: str, fmt: str) -> None:
    """Enrichment targets as csv, json (lines) or parquet."""
    if fmt not in ("csv", "json", "jsonl", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    writer = targets.write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.parquet(path) if fmt == "parquet" else writer.json(path)


def snapshot(products: DataFrame, path: str) -> None:
    """Write a product table as it is."""
    products.write.mode("overwrite").parquet(path)


def restore_products(spark: SparkSession, path: str, current: DataFrame | None, fold) -> DataFrame:
    """A snapshot put back through the product fold, over the current table if there is one."""
    rows = spark.read.parquet(path)
    return fold(rows if current is None else current.unionByName(rows, allowMissingColumns=True))


def is_blocked(status: Column, body: Column) -> Column:
    """Whether a response is a refusal or a challenge."""
    low = F.lower(F.coalesce(body, F.lit("")))
    marked = F.lit(False)
    for m in BLOCKED_MARKS:
        marked = marked | low.contains(m)
    return F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False)) | marked


def drop_blocked_pages(crawl: DataFrame, status_col: str, body_col: str, header_cols: Sequence[str] = ()) -> DataFrame:
    """Pages that aren't blocked. ``header_cols`` name columns of challenge headers: any that says challenge or captcha blocks."""
    blocked = is_blocked(F.col(status_col), F.col(body_col))
    for c in header_cols:
        blocked = blocked | F.coalesce(F.lower(c).rlike("challenge|captcha"), F.lit(False))
    return crawl.where(~blocked)
