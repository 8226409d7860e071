"""Registered queries of imports, evidence and reviews, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.operators import evidence, matches
from quillmart.plans import catalog_queries as cq
from quillmart.plans import log_queries as lq
from quillmart.plans.views import view, with_views
from quillmart.shared import spread
from quillmart.sources import pages, payloads, tables

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


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


# ---- payloads and imports


@query(
    """
SELECT concat(CAST(p_partkey AS VARCHAR), '-', CAST(i AS VARCHAR)) AS source_product_id, p_name AS product_name_ko, p_brand AS source_brand_name, floor(p_retailprice) AS regular_price
FROM part, unnest(range(1, p_partkey % 3 + 2)) AS t(i) WHERE p_partkey % 13 <> 0"""
)
def s7_nested_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a payload whose items lie up to eleven levels deep, behind objects and lists that lead nowhere."""
    n = F.col("p_partkey")
    item = lambda i: text('{"id":"', n.cast("string"), "-", i.cast("string"), '","name":"', F.col("p_name"), '","brand":"', F.col("p_brand"), '","price":"', F.floor("p_retailprice").cast("string"), '","data":[7]}')
    items = text("[", F.array_join(F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), item), ", "), "]")
    levels = F.filter(F.sequence(F.lit(1), F.lit(11)), lambda i: i <= n % 12)
    nested = F.reduce(levels, items, lambda inner, i: F.when(i % 2 == 0, text('{"products": {"n": [1]}, "results": {"items": []}, "data": ', inner, "}")).otherwise(text(' {"items": ', inner, ', "data": {"items": [{"id": "wrong"}]}}')))
    made = F.when(n % 13 == 0, text('{"products": [], "items": ', items, "}")).otherwise(nested)
    rows = spread(part(spark, sf_dir)).select(made.alias("payload"))
    return payloads.map_json_payload(rows, "api").select("source_product_id", "product_name_ko", "source_brand_name", "regular_price")


@query(
    """
WITH r AS (SELECT p_partkey AS line, CASE p_partkey % 9 WHEN 0 THEN 'missing required field: source' WHEN 1 THEN 'source_url does not look like a URL: ''ftp://x''' WHEN 2 THEN 'confidence is not a number: ''high'''
    WHEN 3 THEN 'confidence out of range [0.0, 1.0]: 1.5' WHEN 4 THEN 'missing required field: canonical_product_id' END AS reason FROM part)
SELECT line, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN 0.25::DOUBLE END AS confidence, CASE WHEN reason IS NULL AND line % 2 = 0 THEN true END AS sold_out,
  CASE WHEN reason IS NULL AND line % 3 = 0 THEN 12.5::DOUBLE END AS sale_price FROM r"""
)
def s6_candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    k = n % 9
    rows = part(spark, sf_dir).select(
        n.alias("line"), F.when(k != 4, text("part:", n.cast("string"))).alias("canonical_product_id"), F.when(k == 0, "  ").otherwise("shop").alias("source"), text(" P", n.cast("string")).alias("source_product_id"),
        F.when(k == 1, " ftp://x ").otherwise("https://shop.example/1").alias("source_url"), F.lit("title").alias("match_method"), F.when(k == 2, "high").when(k == 3, "1.5").otherwise("0.25").alias("confidence"),
        F.when(n % 3 == 0, "12.5").otherwise("cheap").alias("sale_price"), F.when(n % 2 == 0, " YES").otherwise("maybe").alias("sold_out"),
    )
    valid, invalid = tables.split_candidates(rows)
    none = lambda t: F.lit(None).cast(t)
    kept = valid.select("line", F.lit(True).alias("valid"), none("string").alias("reason"), "confidence", "sold_out", "sale_price")
    return kept.unionByName(invalid.select("line", F.lit(False).alias("valid"), "reason", none("double").alias("confidence"), none("boolean").alias("sold_out"), none("double").alias("sale_price")))


# ---- evidence


def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product page for each part but every eleventh: names, images and prices of several kinds, in linked data and metas."""
    n = F.col("p_partkey")
    name = F.when(n % 3 == 0, F.concat_ws(" ", "p_brand", "p_name", "p_type")).when(n % 3 == 1, F.concat(F.lit("립 "), "p_name"))
    title = F.when(n % 4 == 0, "한글 제품").when(n % 4 == 1, F.col("p_brand")).when(n % 4 == 2, F.concat(F.lit("Official Store "), "p_name"))
    linked = F.to_json(F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.when(n % 5 == 4, text("http://i/", n.cast("string"))).alias("image"), F.when(n % 6 == 4, F.struct(F.lit(12.5).alias("price"), F.lit("USD").alias("priceCurrency"))).alias("offers")))
    image = F.when(n % 5 == 1, "/rel.jpg").when(n % 5 == 2, text("https://img/", n.cast("string"))).when(n % 5 == 3, "https:https://img")
    price = F.when(n % 6 == 1, "0").when(n % 6 == 2, "1,200원").when(n % 6 == 3, "abc").when(n % 6 == 5, "0.0")
    meta = lambda key, value: F.coalesce(text(f'<meta property="{key}" content="', value, '">'), F.lit(""))
    html = text("<html><head>", F.coalesce(text("<title>", title, "</title>"), F.lit("")), '<script type="application/ld+json">', linked, "</script>", meta("og:image", image), meta("price", price), F.when(n % 6 == 5, '<meta itemprop="price" content="9">').otherwise(""), "<p>open")
    return spread(part(spark, sf_dir).where(n % 11 != 0)).select(text("https://shop.example/p/", n.cast("string")).alias("source_url"), html.alias("html"))


@query(
    r"""
WITH p AS (SELECT *, p_partkey AS n, 'https://shop.example/p/' || p_partkey AS url FROM part),
e AS (SELECT url AS page, list_filter([CASE n % 3 WHEN 0 THEN p_brand || ' ' || p_name || ' ' || p_type WHEN 1 THEN '립 ' || p_name END, CASE n % 4 WHEN 0 THEN '한글 제품' WHEN 1 THEN p_brand WHEN 2 THEN 'Official Store ' || p_name END], lambda x: x IS NOT NULL) AS names,
  CASE n % 5 WHEN 1 THEN '/rel.jpg' WHEN 2 THEN 'https://img/' || n WHEN 3 THEN 'https:https://img' WHEN 4 THEN 'http://i/' || n END AS image,
  CASE n % 6 WHEN 1 THEN ['0'] WHEN 2 THEN ['1,200원'] WHEN 3 THEN ['abc'] WHEN 4 THEN ['12.5'] WHEN 5 THEN ['0.0', '9'] ELSE [] END AS prices, n % 6 = 4 AS dollars FROM p WHERE n % 11 <> 0),
t AS (SELECT n, p_brand, field, CASE WHEN n % 13 <> 0 THEN url ELSE '' END AS url FROM p, (VALUES ('product_name_en'), ('image_url'), ('price')) f(field)),
j AS (SELECT t.*, names, image, prices, dollars, page IS NULL AND url <> '' AS failed, coalesce(names, []) AS ns,
  lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '', 'g')) AS rk FROM t LEFT JOIN e ON t.url = e.page),
k AS (SELECT *, list_filter(ns, lambda x: NOT regexp_matches(x, '[가-힣]') AND NOT contains(lower(x), 'official store') AND len(regexp_extract_all(x, '[A-Za-z0-9]+')) > 1
    AND lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) <> rk AND NOT (len(regexp_extract_all(x, '[A-Za-z0-9]+')) = 2 AND starts_with(lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')), rk)))[1] AS candidate_name,
  list_filter(coalesce(prices, []), lambda x: coalesce(TRY_CAST(nullif(regexp_replace(x, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0) > 0)[1] AS candidate_price,
  list_transform(ns, lambda x: CASE WHEN regexp_matches(x, '[가-힣]') AND regexp_matches(x, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(x, '[가-힣]') THEN 'ko' ELSE 'latin' END) AS langs FROM j),
r AS (SELECT *, CASE WHEN candidate_name IS NOT NULL THEN '' WHEN failed THEN 'fetch_error' WHEN len(ns) = 0 THEN 'no_evidence' WHEN list_contains(langs, 'latin') THEN 'latin_evidence_rejected_low_confidence'
    WHEN list_distinct(langs) = ['mixed'] THEN 'mixed_language_without_latin_product_name' WHEN list_distinct(langs) = ['ko'] THEN 'korean_only_evidence' ELSE 'korean_or_mixed_evidence_only' END AS name_reason,
  CASE field WHEN 'product_name_en' THEN candidate_name IS NOT NULL WHEN 'image_url' THEN coalesce(starts_with(image, 'http') AND NOT starts_with(image, 'https:https'), false) ELSE candidate_price IS NOT NULL END AS usable FROM k)
SELECT n AS part_no, field, candidate_name, image AS candidate_image_url, candidate_price, CASE WHEN dollars AND candidate_price IS NOT NULL THEN 'USD' END AS candidate_currency, usable,
  CASE WHEN usable THEN name_reason WHEN failed THEN 'fetch_error' WHEN field = 'image_url' THEN CASE WHEN image IS NULL THEN 'no_image_evidence' ELSE 'invalid_image_url_evidence' END
    WHEN field = 'price' THEN CASE WHEN len(coalesce(prices, [])) = 0 THEN 'no_price_evidence' ELSE 'non_positive_price_evidence' END ELSE name_reason END AS reason,
  CAST(len(ns) AS INTEGER) AS evidence_count, array_to_string(ns, ' | ') AS evidence_names, array_to_string(langs, ' | ') AS evidence_languages FROM r"""
)
def a16_evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    targets = part(spark, sf_dir).select(
        n.alias("part_no"), F.explode(F.array(*map(F.lit, evidence.FIELDS))).alias("field"), F.lit("shop").alias("source"), F.col("p_brand").alias("brand_en"), F.lit(None).cast("string").alias("brand_ko"),
        F.when(n % 13 != 0, text("https://shop.example/p/", n.cast("string"))).otherwise("").alias("source_url"),
    )
    asked = evidence_pages(spark, sf_dir).join(targets.select("source_url").distinct(), "source_url", "left_semi")
    found = evidence.audit_targets(targets, pages.page_evidence(asked, "source_url"))
    return found.drop("source", "brand_en", "brand_ko", "source_url", "candidate_language", "candidate_source", "error")


# ---- matches


_MAPPINGS = """
mp AS (SELECT observed_at, seq, part_no, supp_no, tie, CASE WHEN seq % 13 = 0 THEN 'part:1' ELSE canonical_product_id END AS canonical_product_id, CASE WHEN seq % 3 = 0 THEN 'new-shop' ELSE source END AS source,
         CASE WHEN seq % 3 = 0 THEN concat('N', CAST(part_no % 50 AS VARCHAR)) ELSE source_product_id END AS source_product_id, CASE WHEN seq % 19 <> 0 THEN source_url ELSE '' END AS source_url FROM listing_obs WHERE seq % 5 = 0),
cm AS (SELECT *, concat('match:', canonical_product_id, ':', source, ':', source_product_id) AS match_id, row(observed_at, seq, part_no, supp_no, tie) AS rnk FROM mp
       WHERE canonical_product_id IS NOT NULL AND source_product_id IS NOT NULL AND source_url <> ''),
cl AS (SELECT source, source_product_id, arg_min(canonical_product_id, rnk) AS claim FROM cm GROUP BY ALL),
ow AS (SELECT source, source_product_id, list(DISTINCT canonical_product_id) AS owners FROM of GROUP BY ALL),
ju AS (SELECT cm.*, owners IS NULL AS fresh, mt.match_id IS NULL AS unmatched, CASE WHEN owners IS NOT NULL THEN list_contains(owners, cm.canonical_product_id) ELSE cm.canonical_product_id = claim END AS linked
       FROM cm JOIN cl ON cm.source = cl.source AND cm.source_product_id = cl.source_product_id LEFT JOIN ow ON cm.source = ow.source AND cm.source_product_id = ow.source_product_id LEFT JOIN mt ON mt.match_id = cm.match_id)"""


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings that an editor has confirmed: some of other products than the offers say, some of a shop without offers yet."""
    seq = F.col("seq")
    rows = cq.observations(spark, sf_dir).where(seq % 5 == 0)
    return rows.select(
        *cq.ORDER, F.when(seq % 13 == 0, "part:1").otherwise(F.col("canonical_product_id")).alias("canonical_product_id"), F.when(seq % 3 == 0, "new-shop").otherwise(F.col("source")).alias("source"),
        F.when(seq % 3 == 0, text("N", (F.col("part_no") % 50).cast("string"))).otherwise(F.col("source_product_id")).alias("source_product_id"), F.when(seq % 19 != 0, F.col("source_url")).otherwise("").alias("source_url"),
    )


@query(
    f"""
WITH {lq._OFFERS}, {_MAPPINGS}
SELECT CASE WHEN linked THEN 'linked' ELSE 'conflict' END AS outcome, linked AND fresh AS needs_offer, linked AND unmatched AS needs_match, count(*) AS n FROM ju GROUP BY ALL
UNION ALL SELECT 'incomplete', false, false, count(*) FROM mp WHERE NOT (canonical_product_id IS NOT NULL AND source_product_id IS NOT NULL AND source_url <> '')""",
    "listing_obs",
)
def m3_confirmed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = lq.offers_and_matches(spark, sf_dir)
    judged = matches.judge_confirmed(known, offers, confirmed(spark, sf_dir), cq.ORDER)
    return judged.groupBy("outcome", "needs_offer", "needs_match").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
WITH {lq._OFFERS}, {_MAPPINGS}
SELECT 'match' AS kind, match_id AS id, canonical_product_id, review_state, reviewed_by, match_method, CAST(confidence AS DOUBLE) AS confidence FROM mt
UNION ALL SELECT DISTINCT 'match', match_id, canonical_product_id, 'verified', 'editor', 'editor_confirmed', 1.0 FROM ju WHERE linked AND unmatched
UNION ALL SELECT 'offer', offer_id, canonical_product_id, NULL, NULL, NULL, NULL FROM of
UNION ALL SELECT DISTINCT 'offer', concat(canonical_product_id, ':', source, ':', source_product_id), canonical_product_id, NULL, NULL, NULL, NULL FROM ju WHERE linked AND fresh""",
    "listing_obs",
)
def m3_confirmed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = lq.offers_and_matches(spark, sf_dir)
    offers, known, _ = matches.backfill_confirmed(known, offers, confirmed(spark, sf_dir), "editor", cq.ORDER, "observed_at")
    none = F.lit(None).cast("string")
    ledger = known.select(F.lit("match").alias("kind"), F.col("match_id").alias("id"), "canonical_product_id", "review_state", "reviewed_by", "match_method", "confidence")
    return ledger.unionByName(offers.select(F.lit("offer").alias("kind"), F.col("offer_id").alias("id"), "canonical_product_id", none.alias("review_state"), none.alias("reviewed_by"), none.alias("match_method"), F.lit(None).cast("double").alias("confidence")))


_FORCED = """
d AS (SELECT seq, match_no, CASE WHEN seq % 9 = 0 THEN 'odd' ELSE decision END AS decision, CASE WHEN seq % 10 <> 0 THEN reviewer ELSE ' ' END AS reviewer, decided_at FROM decisions),
l AS (SELECT c_custkey AS match_no, 'pending_review' AS review_state FROM customer WHERE c_custkey % 2 = 0),
o AS (SELECT d.*, CASE WHEN decision = 'odd' THEN 'invalid_state' WHEN reviewer = ' ' THEN 'no_reviewer' WHEN l.match_no IS NULL THEN 'not_found' ELSE 'updated' END AS outcome FROM d LEFT JOIN l ON d.match_no = l.match_no),
b AS (SELECT match_no, arg_max(row(decision, reviewer, decided_at), row(decided_at, seq)) AS w FROM o WHERE outcome = 'updated' GROUP BY 1)"""


@query(
    f"""
WITH {_FORCED}
SELECT 'ledger' AS kind, l.match_no, coalesce(w[1], review_state) AS state, w[2] AS reviewed_by, w[3] AS at FROM l LEFT JOIN b ON l.match_no = b.match_no
UNION ALL SELECT 'decision', seq, outcome, NULL, NULL FROM o""",
    "decisions",
)
def m4_forced_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = view(spark, sf_dir, "decisions")
    asked = decided.select("seq", F.col("match_no").alias("match_id"), F.when(F.col("seq") % 9 == 0, "odd").otherwise(F.col("decision")).alias("decision"), F.when(F.col("seq") % 10 != 0, F.col("reviewer")).otherwise(" ").alias("reviewer"), "decided_at")
    ledger = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("match_id"), F.lit("pending_review").alias("review_state"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast(decided.schema["decided_at"].dataType).alias("updated_at")
    )
    ledger, judged = matches.force_reviews(ledger, asked, ("decided_at", "seq"))
    rows = ledger.select(F.lit("ledger").alias("kind"), F.col("match_id").alias("match_no"), F.col("review_state").alias("state"), "reviewed_by", F.col("updated_at").alias("at"))
    none = F.lit(None)
    return rows.unionByName(judged.select(F.lit("decision").alias("kind"), F.col("seq").alias("match_no"), F.col("outcome").alias("state"), none.cast("string").alias("reviewed_by"), none.cast(decided.schema["decided_at"].dataType).alias("at")))


@query(
    f"""
WITH {lq._OFFERS},
t AS (SELECT canonical_product_id, arg_max(row(source_brand_name, product_name_en), {cq.SQL_ORDER}) AS w FROM listing_obs WHERE seq % 4 <> 0 GROUP BY 1)
SELECT mt.match_id, w[1] AS brand, w[2] AS name FROM mt LEFT JOIN t ON mt.canonical_product_id = t.canonical_product_id WHERE review_state = 'pending_review'""",
    "listing_obs",
)
def j4_pending_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, known = lq.offers_and_matches(spark, sf_dir)
    products = cq.observations(spark, sf_dir).where(F.col("seq") % 4 != 0).withColumn("product_name_ko", F.col("product_name_en"))
    rows = matches.with_targets(known.where(F.col("review_state") == "pending_review"), products, cq.ORDER)
    return rows.select("match_id", F.col("target.source_brand_name").alias("brand"), F.col("target.product_name_ko").alias("name"))


@query(
    f"""
WITH {lq._OFFERS},
c AS (SELECT concat('match:', o.offer_id) AS match_id, {cq.SQL_ORDER} AS rnk, concat('title=', category) AS evidence
      FROM listing_obs l JOIN of o ON l.canonical_product_id = o.canonical_product_id AND l.source = o.source AND l.source_product_id = o.source_product_id WHERE l.seq % 3 = 0),
b AS (SELECT match_id, arg_max(evidence, rnk) AS e FROM c GROUP BY 1)
SELECT coalesce(mt.match_id, b.match_id) AS match_id, CASE WHEN mt.match_id IS NULL OR (review_state = 'pending_review' AND e IS NOT NULL) THEN e ELSE 'old=x' END AS evidence
FROM mt FULL JOIN b ON mt.match_id = b.match_id""",
    "listing_obs",
)
def m1_candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = lq.offers_and_matches(spark, sf_dir)
    told = lambda kind, value: F.array(F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(1.0).alias("weight")))
    rows = cq.observations(spark, sf_dir).where(F.col("seq") % 3 == 0)
    made = rows.select(
        "canonical_product_id", F.concat_ws(":", "canonical_product_id", "source", "source_product_id").alias("offer_id"), F.lit(0.5).alias("confidence"), F.lit("title").alias("match_method"), told("title", F.col("category")).alias("evidence"), *cq.ORDER,
    )
    merged = matches.merge_candidates(known.withColumn("evidence", told("old", F.lit("x"))), made, offers, cq.ORDER)
    return merged.select("match_id", F.array_join(F.transform("evidence", lambda e: F.concat(e["type"], F.lit("="), e["value"])), ";").alias("evidence"))
