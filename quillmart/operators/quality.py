"""Catalog quality: issues of each product, the report over them, and what to enrich first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.text import brand_key, display_key
from quillmart.operators.merge import missing_fields, quality_score

SEVERITIES = ("required", "display", "enrichment")
#: Marks that have no place in a display name.
DISPLAY_MARKS = ("[", "]", "기획", "단품", "택1", "Colors", "colors", "종", "(", ")")
#: Endings that have no place in a display name, the first that is found counts; letters in either case.
DISPLAY_ENDINGS = {
    "dirty_display_sun_protection_suffix": r"(?:^|\s)SPF\s*\d+\+?\s*,?(?:\s*/\s*PA\+{1,4}|\s+PA\+{1,4}|\s*,\s*PA\+{1,4})?(?:\s+\S.*)?$",
    "dirty_display_bundle_suffix": r"\d+(?:\.\d+)?\s*(?:g|ml|mL|ML)\s*(?:[*xX]\s*\d+\s*(?:ea|EA|입)?|\+\s*\d+(?:\.\d+)?\s*(?:g|ml|mL|ML)(?:\s+\S.*)?|\+\s*\S+)\s*$",
    "dirty_display_volume_descriptor_suffix": r"\d+(?:\.\d+)?\s*(?:g|ml|mL|ML)\s*(?:\*[A-Za-z가-힣0-9\s*]+|\s+증량)\s*$",
}


#: Names of issues, and the details of required ones.
MISSING_NAME = ("missing_product_name", "product_name_ko/product_name_en missing")
MISSING_SOURCE = ("missing_source", "source missing")
MISSING_LOCATOR = ("missing_source_locator", "source_url/source_product_id missing")
DIRTY_NAME, BRAND_PREFIX, MISSING_PREFIX = "dirty_display_name", "brand_prefixed_display_name", "missing_"


def _empty(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _none(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def issue_list() -> Column:
    """``array<struct<severity, issue, detail>>`` of a product with ``product_name_ko, product_name_en, source,
    source_url, source_product_id, product_name_display_ko, brand_ko, brand_en, price, image_url``.

    Required: a name, a source, an address or number there. Display: marks, an ending, a brand before the name.
    Enrichment: each missing field of N7.
    """
    display = F.coalesce("product_name_display_ko", F.lit(""))

    def issue(test: Column, severity: str, name: Column | str, detail: Column | str) -> Column:
        name, detail = (F.lit(x) if isinstance(x, str) else x for x in (name, detail))
        return F.when(test, F.struct(F.lit(severity).alias("severity"), name.alias("issue"), detail.alias("detail")))

    marked = F.exists(F.array(*map(F.lit, DISPLAY_MARKS)), lambda m: F.contains(display, m))
    ending = F.coalesce(*(F.when(display.rlike("(?iU)" + pattern), F.lit(name)) for name, pattern in DISPLAY_ENDINGS.items()))
    own = display_key(display)
    before = lambda brand: (brand != "") & (own != brand) & F.startswith(own, brand)
    branded = F.exists(F.array(display_key(F.col("brand_ko")), display_key(F.col("brand_en"))), before)
    fixed = [
        issue(_none("product_name_ko") & _none("product_name_en"), "required", *MISSING_NAME),
        issue(_none("source"), "required", *MISSING_SOURCE),
        issue(_none("source_url") & _none("source_product_id"), "required", *MISSING_LOCATOR),
        issue(marked, "display", DIRTY_NAME, display),
        issue(ending.isNotNull(), "display", ending, display),
        issue(branded, "display", BRAND_PREFIX, display),
    ]
    missing = missing_fields({c: F.col(c) for c in ("brand_en", "product_name_en", "price", "image_url")})
    wished = F.transform(missing, lambda f: F.struct(F.lit("enrichment").alias("severity"), F.concat(F.lit(MISSING_PREFIX), f).alias("issue"), f.alias("detail")))
    return F.concat(F.array_compact(F.array(*fixed)), wished)


def quality_issues(products: DataFrame, key_col: str) -> DataFrame:
    """A13 in long form: ``key, source, severity, issue, detail``."""
    listed = products.select(F.col(key_col).alias("key"), "source", F.explode(issue_list()).alias("i"))
    return listed.select("key", "source", "i.*")


def quality_report(products: DataFrame) -> DataFrame:
    """A12 in long form, ``(measure, name, value)``: ``total`` (products, issues by severity, products with an English name,
    with a cleaned display name, with a display name given by hand, the mean score), ``source`` (products by family) and
    ``missing_field`` (products by missing field).

    ``products`` has what :func:`issue_list` needs, ``rating, review_count``, and the display names given by hand as
    ``override_ko, override_en``. One pass over products for each measure; without products the mean is 0.
    """
    c = {n: F.col(n) for n in products.columns}
    judged = products.select("*", issue_list().alias("__issues"), quality_score(c).alias("__score"))
    of = lambda severity: F.coalesce(F.sum(F.size(F.filter("__issues", lambda i: i["severity"] == severity))), F.lit(0))
    cleaned = ~_none("product_name_ko") & ~_none("product_name_display_ko") & (F.col("product_name_ko") != F.col("product_name_display_ko"))
    totals = {"total": F.count(F.lit(1))} | {f"{s}_issues": of(s) for s in SEVERITIES}
    totals |= {"product_name_en": F.count_if(~_none("product_name_en")), "display_cleaned": F.count_if(cleaned), "display_ko_override": F.count_if(~_none("override_ko"))}
    totals |= {"display_en_override": F.count_if(~_none("override_en")), "mean_quality": F.coalesce(F.round(F.avg("__score"), 2), F.lit(0.0))}
    row = judged.agg(*(v.cast("double").alias(n) for n, v in totals.items()))
    long = row.select(F.explode(F.array(*(F.struct(F.lit("total").alias("measure"), F.lit(n).alias("name"), F.col(n).alias("value")) for n in totals))).alias("m")).select("m.*")

    def counted(name: Column, measure: str) -> DataFrame:
        return products.select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(measure).alias("measure"), "name", "value")

    missing = F.explode(missing_fields({n: c[n] for n in ("brand_en", "product_name_en", "price", "image_url")}))
    return long.unionByName(counted(F.substring_index(F.coalesce("source", F.lit("")), ":", 1), "source")).unionByName(counted(missing, "missing_field"))


def enrichment_targets(products: DataFrame, issues: DataFrame, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """One target for each ``key``: the first product by ``order`` with an open enrichment field.

    A missing English name is no target if another product of the canonical group has one; rows without canonical id
    are never excluded by that.
    """
    named = products.where(~_empty("name_en") & F.col("canonical_product_id").isNotNull()).select("canonical_product_id").distinct()
    open_ = issues.where(F.col("code") == "missing_enrichment").select(F.col("key").alias("__key"), "field")
    rows = products.join(open_, products["key"] == open_["__key"]).drop("__key")
    english = rows.where(F.col("field") == "name_en").join(named, "canonical_product_id", "left_anti").select(rows.columns)
    rows = english.unionByName(rows.where(F.col("field") != "name_en"))
    best = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") == 1).drop("__rn")


def number_targets(targets: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` targets with their priority; they are numbered after the limit, so one task sees ``limit`` rows."""
    return targets.orderBy(*order).limit(limit).withColumn("priority", F.row_number().over(Window.orderBy(*order)))


def brand_corrections(products: DataFrame) -> DataFrame:
    """Source brands whose key differs from the official brand's, with their number of products, most frequent first."""
    wrong = products.where((brand_key(F.col("source_brand_name")) != brand_key(F.col("official_brand"))) & F.col("official_brand").isNotNull())
    return wrong.groupBy("source_brand_name", "official_brand").agg(F.count(F.lit(1)).alias("products"))


def export_report(products: DataFrame, top_brands: int = 40) -> DataFrame:
    """A15 in long form: ``(measure, name, value)`` of an export's products: totals, sources by family, the most frequent brands.

    ``products`` has ``source, source_brand_name, brand_ko, brand_en, product_name_ko, product_name_en,
    product_name_display_ko, rating, review_count, options, sold_out, quality_score``.
    """
    c = F.col
    corrected = (F.coalesce("source_brand_name", F.lit("")) != "") & c("brand_ko").isNotNull() & (brand_key(c("source_brand_name")) != brand_key(c("brand_ko")))
    counts = {
        "total": F.lit(True), "product_name_en": c("product_name_en").isNotNull(), "rating": c("rating").isNotNull(), "review_count": c("review_count").isNotNull(), "options": F.size("options") > 0,
        "sold_out": c("sold_out"), "brand_corrected": corrected, "display_cleaned": c("product_name_ko") != c("product_name_display_ko"), "missing_brand_ko": c("brand_ko").isNull(), "missing_brand_en": c("brand_en").isNull(),
    }
    totals = products.agg(*(F.count_if(test).cast("double").alias(n) for n, test in counts.items()), F.coalesce(F.round(F.avg("quality_score"), 2), F.lit(0.0)).alias("mean_quality"))
    names = (*counts, "mean_quality")
    long = totals.select(F.explode(F.array(*(F.struct(F.lit("total").alias("measure"), F.lit(n).alias("name"), c(n).alias("value")) for n in names))).alias("m")).select("m.*")
    counted = lambda column, measure: products.where(column.isNotNull()).groupBy(column.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(measure).alias("measure"), "name", "value")
    brands = counted(F.nullif(c("source_brand_name"), F.lit("")), "brand").orderBy(F.desc("value"), "name").limit(top_brands)
    return long.unionByName(counted(F.substring_index("source", ":", 1), "source")).unionByName(brands)
