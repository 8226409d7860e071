"""Registered queries of parsers, query classes, filters, reports, editor lines and versioned reviews, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmart.functions import text
from quillmart.operators import analytics, editor, jobs, matches, matching, normalize, quality, results
from quillmart.plans import catalog_queries as cq
from quillmart.plans.views import sql_key, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


# ---- parsers


@query(
    """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.5 WHEN 1 THEN p_size END::DOUBLE AS number, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + p_size // 2 WHEN 1 THEN p_size END::BIGINT AS whole,
  CASE WHEN p_partkey % 4 = 1 THEN p_size WHEN p_partkey % 4 = 0 THEN p_size * 10005 END::BIGINT AS digits,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_type || '|' || p_name WHEN 2 THEN p_name END AS options,
  CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS sold_out, p_size > 0 AND p_partkey % 3 <> 0 AS positive, p_partkey % 2 = 0 AS usable, p_brand AS brand,
  CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0 END::DOUBLE AS decimals FROM part"""
)
def f17_lenient_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, F20, F21 over texts made of every part."""
    n, size = F.col("p_partkey"), F.col("p_size")
    grouped = F.format_string("%,.1f", size.cast("double") * 1000.5)
    number = F.when(n % 4 == 0, grouped).when(n % 4 == 1, said(" ", size.cast("string"), " ")).when(n % 4 == 2, "n/a")
    flag = F.when(n % 3 == 0, " YES ").when(n % 3 == 1, "In_Stock").otherwise("perhaps")
    options = F.when(n % 5 == 0, said('["', F.col("p_name"), '", "", "', F.col("p_type"), '"]')).when(n % 5 == 1, said(" ", F.col("p_type"), " | |", F.col("p_name"))).when(n % 5 == 2, F.col("p_name")).when(n % 5 == 3, " ")
    stock = F.when(n % 4 == 0, "SOLD_OUT").when(n % 4 == 1, "in_stock now").when(n % 4 == 2, "일시 품절").otherwise("soon")
    price = F.when(n % 3 == 0, "0.0원").otherwise(said(size.cast("string"), "원."))
    return part(spark, sf_dir).select(
        n.alias("id"), text.parse_number(number).alias("number"), text.parse_whole_number(number).alias("whole"), text.payload_int(number).alias("digits"), text.parse_bool(flag).alias("flag"),
        F.array_join(text.parse_options(options), "|").alias("options"), text.sold_out_from_status(stock).alias("sold_out"), text.is_positive_price(price).alias("positive"),
        text.is_usable_image_url(F.when(n % 2 == 0, "https://i/1").otherwise("https:https://i/1")).alias("usable"), text.brand_from_name(said("[NEW] [세트]", F.col("p_brand"), " ", F.col("p_name"))).alias("brand"),
        text.payload_float(F.when(n % 2 == 0, F.replace((size / 10.0).cast("string"), F.lit("."), F.lit(",")))).alias("decimals"),
    )


_HANGUL = ("가람", "나루", "다온", "라온", "마루", "바론", "사월", "아라", "자온", "차오")
_INITIAL = ("ㄱ", "ㄴ", "ㄷ", "ㄹ", "ㅁ", "ㅂ", "ㅅ", "ㅇ", "ㅈ", "ㅊ")


@query(
    f"""
WITH l AS (SELECT p_partkey AS id, CAST(p_partkey % 10 AS INTEGER) + 1 AS i, [{', '.join(f"'{w}'" for w in _HANGUL)}] AS words FROM part)
SELECT id AS key, 'Brand ' || (i - 1) AS official_en, words[i] AS alias FROM l WHERE id % 3 <> 2"""
)
def f24_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names in which the first, or the second, syllable of a brand is written as its initial."""
    n = F.col("p_partkey")
    i = (n % 10 + 1).cast("int")
    word, first = F.element_at(F.array(*map(F.lit, _HANGUL)), i), F.element_at(F.array(*map(F.lit, _INITIAL)), i)
    second = normalize.hangul_initials(F.substring(word, 2, 1))
    spoken = F.when(n % 3 == 0, F.concat(first, F.substring(word, 2, 1))).when(n % 3 == 1, F.concat(F.substring(word, 1, 1), second)).otherwise(F.concat(first, F.lit("x")))
    rows = part(spark, sf_dir).select(n.alias("id"), said(F.col("p_name"), " ", spoken, " ", F.col("p_type")).alias("name"))
    aliases = normalize.alias_table(rows.select((F.col("id") % 10).alias("d")).distinct().select(said("Brand ", F.col("d").cast("string")).alias("official_en"), F.element_at(F.array(*map(F.lit, _HANGUL)), (F.col("d") + 1).cast("int")).alias("alias"), F.lit(0).alias("position")))
    return normalize.initials_match(rows, aliases, "id", "name")


@query(
    """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'brand' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'broad' ELSE 'ordinary' END WHEN 2 THEN 'discovery' ELSE 'ordinary' END AS class FROM part"""
)
def f30_query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brands alone, single words with and without related queries, words of discovery, whole names."""
    n = F.col("p_partkey")
    asked = F.when(n % 4 == 0, F.col("p_brand")).when(n % 4 == 1, F.split_part("p_type", F.lit(" "), F.lit(1))).when(n % 4 == 2, "수분").otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    product = F.when(n % 4 == 0, "").when(n % 4 == 3, F.col("p_name")).otherwise(asked)
    return part(spark, sf_dir).select(n.alias("id"), matching.query_class(asked, F.when((n % 4 == 0) | (n % 4 == 3), F.col("p_brand")), product, (n % 4 == 1) & (F.col("p_size") % 2 == 0)).alias("class"))


@query(
    """
SELECT l_orderkey AS box_id, string_agg(concat_ws(' ', p_brand, p_name, CASE WHEN l_linenumber % 2 = 0 THEN p_type END, 'https://s/' || p_partkey), chr(10) ORDER BY l_linenumber, concat_ws(' ', p_brand, p_name, CASE WHEN l_linenumber % 2 = 0 THEN p_type END, 'https://s/' || p_partkey)) AS text
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def f32_description_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    items = lines.select(F.col("l_orderkey").alias("box_id"), F.col("l_linenumber").alias("position"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise(" ").alias("shade"), said("https://s/", F.col("p_partkey").cast("string")).alias("link"))
    return editor.description_text(items, links=True)


# ---- reports and filters


@query(
    """
WITH j AS (SELECT * FROM judged),
m AS (SELECT 'total' AS measure, unnest(['total', 'product_name_en', 'rating', 'review_count', 'options', 'sold_out', 'brand_corrected', 'display_cleaned', 'missing_brand_ko', 'missing_brand_en', 'mean_quality']) AS name,
  unnest([count(*), count(product_name_en), count(rating), count(review_count), count(*) FILTER (seq % 2 = 0), count(*) FILTER (seq % 3 = 0), count(*) FILTER (brand_ko IS NOT NULL AND lower(regexp_replace(brand_en, '[\\s\\-_./]+', '', 'g')) <> lower(regexp_replace(brand_ko, '[\\s\\-_./]+', '', 'g'))),
    count(*) FILTER (product_name_ko <> product_name_display_ko), count(*) FILTER (brand_ko IS NULL), count(*) FILTER (brand_en IS NULL), round(avg(seq % 100), 2)]) AS value FROM j)
SELECT measure, name, CAST(value AS DOUBLE) AS value FROM m UNION ALL SELECT 'source', split_part(source, ':', 1), CAST(count(*) AS DOUBLE) FROM j GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'brand', brand_en, CAST(count(*) AS DOUBLE) AS n FROM j WHERE brand_en IS NOT NULL GROUP BY 2 ORDER BY n DESC, brand_en LIMIT 10)""".replace("\\\\", "\\"),
    "judged",
)
def a15_export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    rows = view(spark, sf_dir, "judged").withColumns({"source_brand_name": F.col("brand_en"), "options": F.when(seq % 2 == 0, F.array(F.lit("o"))).otherwise(F.array().cast("array<string>")), "sold_out": seq % 3 == 0, "quality_score": (seq % 100).cast("int")})
    return quality.export_report(rows, 10)


@query(
    """
WITH f AS (SELECT p_type, arg_min(p_name, row(-p_retailprice, p_partkey)) AS found FROM part WHERE p_size > 10 GROUP BY 1)
SELECT q.p_brand || ':' || q.p_type AS query_id, q.want AS expected, found, coalesce(found = q.want, false) AS passed FROM (SELECT p_brand, p_type, max(p_name) AS want FROM part GROUP BY ALL) q LEFT JOIN f ON q.p_type = f.p_type"""
)
def a18_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    asked = p.groupBy("p_brand", "p_type").agg(F.max("p_name").alias("expected")).select(F.concat_ws(":", "p_brand", "p_type").alias("query_id"), "p_type", "expected")
    order = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = p.where(F.col("p_size") > 10).withColumn("rank", F.row_number().over(order)).select("p_type", "rank", F.col("p_name").alias("name"))
    found = asked.select("query_id", "p_type").join(ranked, "p_type").select("query_id", "rank", "name")
    return analytics.check_expectations(asked.drop("p_type"), found).select("query_id", "expected", "found", "passed")


@query("SELECT o_custkey % 50 AS run, count(*) AS queries, CAST(sum(o_custkey % 6) AS BIGINT) AS products, CAST(sum(o_custkey % 4) AS BIGINT) AS stored, count(*) FILTER (o_orderkey % 3 = 0) AS failures FROM orders GROUP BY 1")
def a22_ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = view(spark, sf_dir, "jobs").join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")
    rows = done.select((F.col("o_custkey") % 50).alias("run"), "product_count", F.col("attempt_count").alias("stored_count"), F.col("last_error").alias("error"))
    return analytics.ingestion_summary(rows)


@query(
    """
SELECT seq, source, CASE WHEN source = '' THEN NULL ELSE 1 END AS n_offers FROM judged
WHERE (coalesce(product_name_ko, '') <> '' OR coalesce(product_name_en, '') <> '') AND source IN ('oliveyoung', 'official:global') AND (coalesce(source_url, '') <> '' OR coalesce(source_product_id, '') <> '')""",
    "judged",
)
def r11_allowed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole products of allowed sources, with their offers of such sources."""
    offers = F.array(F.struct(F.col("source").alias("source")), F.struct(F.lit("musinsa").alias("source")))
    rows = view(spark, sf_dir, "judged").withColumn("offers", offers)
    kept = results.only_allowed(results.core_complete(rows), ["oliveyoung", "official"])
    return kept.select("seq", "source", F.size("offers").alias("n_offers"))


@query(
    """
SELECT p_partkey AS id, CASE WHEN n >= 20 THEN true WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 0 THEN n > 0 ELSE n >= 8 END AS enough FROM (SELECT p_partkey, p_size % 30 AS n FROM part)"""
)
def r17_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return part(spark, sf_dir).select(n.alias("id"), results.is_sufficient(F.col("p_size") % 30, 20, n % 2 == 0, n % 3 == 0).alias("enough"))


@query(
    """
WITH s AS (SELECT p_type AS query_id, p_partkey AS idx, p_size AS q, p_partkey % 3 AS score FROM part)
SELECT query_id, idx AS "index", CAST(row_number() OVER (PARTITION BY query_id ORDER BY -q, idx) AS INTEGER) AS rank FROM s WHERE score > 0"""
)
def r9_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant results of a type by quality, then in their source's order."""
    scored = part(spark, sf_dir).select(F.col("p_type").alias("query_id"), F.col("p_partkey").alias("index"), F.col("p_size").alias("quality_score"), F.lit(10).alias("source_priority"), (F.col("p_partkey") % 3).cast("int").alias("match_score"), F.lit(True).alias("strict"))
    return matching.rank_matches(scored, by_score=False).select("query_id", "index", "rank")


# ---- editor lines


_LINES = f"""
ln AS (SELECT p_partkey AS line_id, p_brand AS brand, p_name AS product, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) END AS code FROM part),
wd AS (SELECT *, list_filter(list_transform(regexp_extract_all(product, '[0-9A-Za-z가-힣]+'), lambda w: {sql_key("w")}), lambda w: w <> '') AS words FROM ln)"""


def editor_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part as a line of its brand, name and (every fourth) shade code, and every part as a product."""
    n, none = F.col("p_partkey"), F.lit(None).cast("string")
    lines = part(spark, sf_dir).select(n.alias("line_id"), F.col("p_brand").alias("brand_query"), F.col("p_name").alias("product_query"), F.when(n % 4 == 0, F.col("p_size").cast("string")).alias("shade_code"), none.alias("shade_name"))
    products = part(spark, sf_dir).select(
        n.alias("product_id"), none.alias("brand_ko"), F.col("p_brand").alias("brand_en"), none.alias("name_ko"), F.col("p_name").alias("name_en"), F.when(n % 2 == 0, F.col("p_size").cast("string")).alias("shade"), F.col("p_type").alias("category"),
        F.when(n % 7 != 0, "u").alias("source_url"), F.when(n % 3 == 0, "i").alias("image_url"), (n % 50).cast("int").alias("quality_score"), (n % 90).cast("int").alias("source_priority"),
    )
    return lines.withColumns({"require_brand": F.col("line_id") % 5 != 0, "step": F.lit(0)}), products


_JUDGED = f"""
{_LINES},
pr AS (SELECT w.line_id, w.brand, w.code, w.words, d.p_partkey AS product_id, w.line_id % 5 <> 0 AS strict, {sql_key("d.p_brand")} AS brands, {sql_key("concat_ws(' ', d.p_brand, d.p_name)")} AS names, {sql_key("w.brand")} AS bk, {sql_key("w.code")} AS ck,
   {sql_key("concat_ws(' ', d.p_name, d.p_type, CASE WHEN d.p_partkey % 2 = 0 THEN CAST(d.p_size AS VARCHAR) END)")} AS product, {sql_key("concat_ws(' ', CASE WHEN d.p_partkey % 2 = 0 THEN CAST(d.p_size AS VARCHAR) END, d.p_name)")} AS shades FROM wd w JOIN part d ON w.product = d.p_name),
mt AS (SELECT *, len(list_filter(words, lambda x: contains(product, x))) AS met, len(words) AS n, ck <> '' AS coded, ck <> '' AND contains(shades, ck) AS shaded FROM pr),
ju AS (SELECT *, contains(brands, bk) AS brand_matches, NOT coded OR shaded AS shade_matches, product_id % 50 + greatest(0, 80 - product_id % 90) + 8 + 10 + CASE WHEN product_id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN contains(brands, bk) THEN 40 ELSE 0 END
   + met * 18 + CASE WHEN met = n THEN 20 ELSE 0 END + CASE WHEN shaded THEN 45 ELSE 0 END - CASE WHEN coded AND NOT shaded THEN 35 ELSE 0 END AS match_score
   FROM mt WHERE product_id % 7 <> 0 AND met >= CASE WHEN n <= 2 THEN n ELSE greatest(2, n - 1) END AND (NOT strict OR contains(names, bk))),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY match_score DESC, product_id) AS rank FROM ju) WHERE rank <= 5 AND brand_matches),
tl AS (SELECT line_id, count(*) AS n, arg_min(product_id, rank) AS best, bool_and(shade_matches) AS sure FROM tp GROUP BY 1),
rs AS (SELECT ln.line_id, CASE WHEN n IS NULL THEN '{editor.MANUAL}' WHEN n = 1 AND sure THEN '{editor.CONFIRMED}' ELSE '{editor.CANDIDATES}' END AS status, coalesce(n, 0) AS n_candidates, best FROM ln LEFT JOIN tl ON ln.line_id = tl.line_id)"""


@query(f"WITH {_JUDGED} SELECT line_id, product_id, brand_matches, shade_matches, CAST(match_score AS INTEGER) AS match_score FROM ju")
def r19_editor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, products = editor_parts(spark, sf_dir)
    judged = editor.judge_all(lines, products, "product_query", "name_en")
    return judged.select("line_id", "product_id", "brand_matches", "shade_matches", F.col("match_score").cast("int").alias("match_score"))


def resolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, products = editor_parts(spark, sf_dir)
    return editor.resolve_kinds(*editor.judge_lines(lines, products, "product_query", "name_en", most=5), 5)


@query(f"WITH {_JUDGED} SELECT line_id, status, n_candidates, best FROM rs")
def r21_editor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_lines(spark, sf_dir)


@query(f"WITH {_JUDGED} SELECT status, count(*) AS lines, count(*) FILTER (n_candidates > 0) AS with_candidates FROM rs GROUP BY 1")
def a19_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editor.batch_summary(resolved_lines(spark, sf_dir))


@query(
    f"""
WITH {_LINES},
st AS (SELECT line_id, 0 AS step, concat_ws(' ', brand, product, code) AS query, true AS require_brand FROM ln UNION ALL SELECT line_id, 1, concat_ws(' ', brand, product), true FROM ln
  UNION ALL SELECT line_id, 2, product, false FROM wd WHERE code IS NOT NULL OR len(regexp_extract_all(product, '[0-9A-Za-z가-힣]+')) >= 2),
ks AS (SELECT *, {sql_key("query")} AS key FROM st)
SELECT line_id, CAST(min(step) AS INTEGER) AS step, arg_min(query, step) AS query, require_brand FROM ks WHERE key <> '' GROUP BY line_id, key, require_brand"""
)
def r20_editor_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = editor_parts(spark, sf_dir)
    whole = F.concat_ws(" ", "brand_query", "product_query")
    return editor.ladder(lines.withColumns({"normalized_query": whole, "raw_text": whole}))


# ---- reviews and gaps


@query(
    """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY match_no ORDER BY decided_at, seq) AS i,
    CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 4 = 1 THEN TIMESTAMP '1990-01-01' ELSE lag(decided_at) OVER (PARTITION BY match_no ORDER BY decided_at, seq) END AS expected FROM decisions),
m AS (SELECT c_custkey AS match_no FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT match_no, CAST(0 AS BIGINT) AS i, 'pending_review' AS state, TIMESTAMP '1990-01-01' AS version, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS previous_state, CAST(NULL AS VARCHAR) AS outcome FROM m
  UNION ALL SELECT f.match_no, e.i, CASE WHEN (expected IS NULL OR expected = version) AND decision <> state THEN decision ELSE state END, CASE WHEN (expected IS NULL OR expected = version) AND decision <> state THEN decided_at ELSE version END,
    e.seq, state, CASE WHEN expected IS NOT NULL AND expected <> version THEN 'conflict' WHEN decision = state THEN 'noop' ELSE 'updated' END FROM f JOIN e ON e.match_no = f.match_no AND e.i = f.i + 1)
SELECT match_no, seq, previous_state, outcome FROM f WHERE seq IS NOT NULL UNION ALL SELECT e.match_no, seq, NULL, 'not_found' FROM e ANTI JOIN m ON e.match_no = m.match_no""",
    "decisions",
)
def m4_versioned_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 with expected versions: none, the first one, or the time of the decision before."""
    before = F.lag("decided_at").over(Window.partitionBy("match_no").orderBy("decided_at", "seq"))
    first = F.lit("1990-01-01").cast("timestamp_ntz")
    rows = view(spark, sf_dir, "decisions").withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))
    rows = rows.withColumn("expected_version", F.when(F.col("seq") % 4 == 1, first).when(F.col("seq") % 4 >= 2, before)).withColumnRenamed("match_no", "match_id")
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("match_id"), F.lit("pending_review").alias("review_state"), first.alias("updated_at"))
    told = matches.apply_versioned_reviews(known, rows, ("decided_at", "seq"))
    return told.select(F.col("match_id").alias("match_no"), "seq", "previous_state", "outcome")


@query(
    f"""
WITH g AS (SELECT DISTINCT p_brand AS query, p_brand AS query_key, CASE WHEN right(p_brand, 1) IN ('1', '2') THEN 10 ELSE 20 END AS priority FROM part),
al AS (SELECT DISTINCT p_brand AS official, unnest([p_brand, replace(p_brand, '#', ' No. ')]) AS alias FROM part), ak AS (SELECT *, {sql_key("alias")} AS alias_key FROM al),
nr AS (SELECT query, priority, official, row_number() OVER (PARTITION BY query ORDER BY min(length(alias_key)), official) AS bn FROM (SELECT *, {sql_key("query")} AS qkey FROM g) JOIN ak ON contains(alias_key, qkey) OR starts_with(qkey, alias_key) GROUP BY query, priority, official),
cn AS (SELECT query, priority, row(0, 0, 0, query) AS place, query AS asked FROM g UNION ALL SELECT query, priority, row(1, bn, length(alias), alias), alias FROM nr JOIN al ON nr.official = al.official WHERE bn <= 8),
on1 AS (SELECT query AS base, min(place) AS place, arg_min(asked, place) AS asked, CAST(any_value(priority) AS INTEGER) AS priority FROM cn GROUP BY query, lower(asked))
SELECT asked AS query, priority, CAST(row_number() OVER (PARTITION BY base ORDER BY place) - 1 AS INTEGER) AS candidate FROM on1"""
)
def m14_gap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of every brand, and the names of the brands they touch."""
    brands = part(spark, sf_dir).select("p_brand").distinct()
    reason = F.when(F.substring("p_brand", -1, 1).isin("1", "2"), "empty_result").otherwise("low_result_count")
    gaps = brands.select(F.col("p_brand").alias("query_key"), F.col("p_brand").alias("query"), reason.alias("last_reason"))
    named = brands.select(F.col("p_brand").alias("official_en"), F.explode(F.array("p_brand", F.replace("p_brand", F.lit("#"), F.lit(" No. ")))).alias("alias"))
    aliases = named.select(text.search_key(F.col("alias")).alias("alias_key"), "alias", "official_en")
    return jobs.gap_requests(gaps, aliases).select("query", "priority", F.col("position.candidate").alias("candidate"))
