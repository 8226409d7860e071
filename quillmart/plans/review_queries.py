"""Registered queries of offers with reviews, imports, jobs, scores, suggestions, pasted lines and further streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmart.operators import editor, jobs, matches, matching, merge, results, search, upsert
from quillmart.plans import catalog_queries as cq
from quillmart.plans import log_queries as lq
from quillmart.plans.views import sql_key, view, with_views
from quillmart.shared import fresh_path, spread
from quillmart.streaming import query_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- ledger


@query(
    f"""
WITH {lq._OFFERS}
SELECT of.canonical_product_id, count(*) AS offers, count(*) FILTER (review_state = 'verified') AS verified, count(*) FILTER (review_state = 'pending_review') AS pending,
       count(*) FILTER (review_state IS NULL) AS unmatched
FROM of LEFT JOIN mt ON of.offer_id = mt.offer_id AND of.canonical_product_id = mt.canonical_product_id GROUP BY 1""",
    "listing_obs",
)
def j3_offers_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = lq.offers_and_matches(spark, sf_dir)
    joined = offers.join(known.select("offer_id", "canonical_product_id", "review_state"), ["offer_id", "canonical_product_id"], "left")
    state = F.col("review_state")
    return joined.groupBy("canonical_product_id").agg(
        F.count(F.lit(1)).alias("offers"), F.count_if(state == "verified").alias("verified"), F.count_if(state == "pending_review").alias("pending"), F.count_if(state.isNull()).alias("unmatched")
    )


@query(
    f"""
WITH {lq._OFFERS}
SELECT match_id, source, source_product_id FROM (SELECT mt.*, of.source, of.source_product_id FROM mt JOIN of ON mt.offer_id = of.offer_id)
WHERE review_state = 'pending_review' AND source = 'coupang' AND match_id > 'match:part:5' ORDER BY match_id LIMIT 50""",
    "listing_obs",
)
def m5_pending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = lq.offers_and_matches(spark, sf_dir)
    page = matches.pending_page(known, offers.withColumn("source_url", F.lit("u")), 50, after="match:part:5", source="coupang")
    return page.select("match_id", "source", "source_product_id")


@query(
    f"""
WITH {lq._OFFERS},
i AS (SELECT CASE WHEN seq % 13 = 0 THEN 'part:1' ELSE canonical_product_id END AS canonical_product_id, source, source_product_id, CASE WHEN seq % 17 = 0 THEN '7' ELSE '0.5' END AS confidence FROM listing_obs),
k AS (SELECT DISTINCT canonical_product_id FROM of WHERE canonical_product_id <> 'part:2'),
w AS (SELECT source, source_product_id, min(canonical_product_id) AS owner FROM of GROUP BY ALL),
j AS (SELECT CASE WHEN i.canonical_product_id IS NULL THEN 'missing canonical_product_id' WHEN i.source_product_id IS NULL THEN 'missing source_product_id' WHEN i.confidence = '7' THEN 'confidence' END AS reason,
     k.canonical_product_id IS NOT NULL AS known, owner <> i.canonical_product_id AS other, review_state
   FROM i LEFT JOIN k ON i.canonical_product_id = k.canonical_product_id LEFT JOIN w ON i.source = w.source AND i.source_product_id = w.source_product_id
   LEFT JOIN mt ON mt.match_id = concat('match:', i.canonical_product_id, ':', i.source, ':', i.source_product_id))
SELECT CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN NOT known THEN 'unknown' WHEN other THEN 'conflict' WHEN review_state IS NULL THEN 'created' WHEN review_state = 'pending_review' THEN 'updated' ELSE 'preserved' END AS outcome,
  reason, count(*) AS n FROM j GROUP BY ALL""",
    "listing_obs",
)
def m7_import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = lq.offers_and_matches(spark, sf_dir)
    rows = cq.observations(spark, sf_dir).select(
        F.when(F.col("seq") % 13 == 0, "part:1").otherwise(F.col("canonical_product_id")).alias("canonical_product_id"), "source", "source_product_id", "source_url",
        F.lit("title").alias("match_method"), F.when(F.col("seq") % 17 == 0, "7").otherwise("0.5").alias("confidence"),
    )
    products = offers.select("canonical_product_id").where(F.col("canonical_product_id") != "part:2")
    return matches.import_candidates(rows, products, offers, known).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'completed' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN id % 4 = 0 THEN greatest(CAST(id % 9 AS INTEGER) - 3, 0) ELSE product_count END AS product_count, CASE WHEN id % 4 = 0 THEN 'done' ELSE last_error END AS last_error,
  CASE WHEN id % 4 = 0 THEN started_at + INTERVAL 7 DAY ELSE finished_at END AS finished_at, CASE WHEN id % 4 = 0 THEN started_at + INTERVAL 7 DAY ELSE last_seen_at END AS last_seen_at,
  CASE WHEN id % 4 = 0 THEN started_at + INTERVAL 7 DAY ELSE updated_at END AS updated_at FROM jobs""",
    "jobs",
)
def m11_complete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = view(spark, sf_dir, "jobs")
    done = table.where(F.col("id") % 4 == 0).select(
        "id", F.when(F.col("id") % 8 == 0, "completed").otherwise("odd").alias("new_status"), (F.col("id") % 9 - 3).cast("int").alias("new_count"), F.lit("done").alias("new_error"), F.expr("started_at + INTERVAL 7 DAY").alias("at")
    )
    return jobs.complete_jobs(table, done).select("id", "status", "product_count", "last_error", "finished_at", "last_seen_at", "updated_at")


@query(
    f"""
WITH x AS (SELECT part_no AS canonical_product_id, source, source_product_id, source_url, tie AS price, CASE WHEN seq % 11 = 0 THEN 'verified' WHEN seq % 7 = 0 THEN 'pending_review' END AS review_state,
    CASE source WHEN 'oliveyoung' THEN 10 WHEN 'oliveyoung-global' THEN 15 WHEN 'musinsa' THEN 30 WHEN 'official' THEN 20 WHEN 'coupang' THEN 35 ELSE 45 END AS p FROM listing_obs),
d AS (SELECT DISTINCT * FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY canonical_product_id, source, coalesce(source_product_id, source_url) ORDER BY review_state IS NULL, (source_product_id IS NOT NULL)::int DESC,
    source, source_product_id NULLS FIRST, source_url, price, review_state NULLS FIRST) AS rn FROM d),
o AS (SELECT * FROM r WHERE rn = 1)
SELECT canonical_product_id, count(*) FILTER (review_state IS NULL OR review_state = 'verified') AS shown, CAST(count(*) FILTER (review_state = 'pending_review') AS INTEGER) AS pending_offers FROM o GROUP BY 1""",
    "listing_obs",
)
def j12_attach_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored offers merged into results without any."""
    from quillmart.functions.keys import source_priority

    seq = F.col("seq")
    obs = cq.observations(spark, sf_dir)
    offers = obs.select(
        F.col("part_no").alias("canonical_product_id"), "source", "source_product_id", "source_url", F.col("tie").alias("price"), F.lit(None).cast("double").alias("original_price"),
        F.lit(None).cast("double").alias("sale_price"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("updated_at"),
        F.when(seq % 11 == 0, "verified").when(seq % 7 == 0, "pending_review").alias("review_state"), source_priority(F.col("source")).alias("source_priority"),
    ).distinct()
    fields = [c for c in offers.columns if c != "canonical_product_id"]
    kind = f"array<struct<{','.join(f'{n}:{t}' for n, t in offers.dtypes if n != 'canonical_product_id')}>>"
    found = offers.select("canonical_product_id").distinct().withColumn("offers", F.array().cast(kind))
    shown = merge.attach_offers(found, offers, fields)
    return shown.select("canonical_product_id", F.size("offers").cast("long").alias("shown"), "pending_offers")


# ---- search


@query(
    f"""
WITH q AS (SELECT DISTINCT p_name AS query, p_brand AS term FROM part),
d AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, p_type AS category, p_size, p_retailprice, CAST(p_partkey % 4 * 2 AS INTEGER) AS idx FROM part),
p AS (SELECT q.query, q.term, d.*, {sql_key("q.query")} AS qk, {sql_key("d.name")} AS nk, {sql_key("d.brand")} AS bk, {sql_key("d.category")} AS ck, {sql_key("concat_ws(' ', d.name, d.brand, d.category)")} AS wk, {sql_key("q.term")} AS tk
      FROM q JOIN d ON q.term = d.brand),
s AS (SELECT *, CASE WHEN contains(nk, qk) THEN 120 ELSE 0 END + CASE WHEN contains(bk, qk) THEN 90 ELSE 0 END + CASE WHEN contains(ck, qk) THEN 45 ELSE 0 END
   + 8 * len(list_filter(regexp_extract_all(query, '[0-9A-Za-z가-힣]+'), lambda t: length(t) >= 2 AND contains(wk, lower(t)))) + CASE WHEN contains(wk, tk) THEN 18 ELSE 0 END
   + least(greatest(p_size / 4.0, 0), 5) * 2 + least(log10(p_size + 1) * 4, 16) AS base FROM p)
SELECT query, id, round(CAST(base AS DOUBLE) + 40 * 0.05 - idx * 0.001, 2) AS score FROM s WHERE base > 0"""
)
def r7_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    asked = part.select(F.col("p_name").alias("query"), F.col("p_brand").alias("term")).distinct()
    docs = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), none.alias("brand_en"), F.col("p_name").alias("name"), none.alias("name_en"), F.col("p_type").alias("category"), none.alias("description"),
        empty.alias("tags"), empty.alias("ingredients"), empty.alias("review_keywords"), (F.col("p_size") / 4.0).alias("rating"), F.col("p_size").alias("review_count"), F.lit(None).cast("int").alias("sales_count"),
        F.lit(40).alias("quality_score"), (F.col("p_partkey") % 4 * 2).cast("int").alias("index"),
    )
    asked, docs = search.with_asked_keys(spread(asked).withColumn("expanded_terms", F.array("term"))), search.with_document_keys(spread(docs))
    pairs = asked.join(docs, asked["term"] == docs["brand"])
    return search.score_documents(pairs).select("query", "id", "score")


@query(
    f"""
WITH c AS (SELECT p_name AS text, min(p_partkey) AS position FROM part GROUP BY p_name), k AS (SELECT {sql_key("text")} AS key, text, position FROM c),
p AS (SELECT DISTINCT substring(p_name, 1, 3) AS prefix FROM part), pk AS (SELECT prefix, {sql_key("prefix")} AS key FROM p),
r AS (SELECT prefix AS prefix_id, text, row_number() OVER (PARTITION BY prefix ORDER BY starts_with(k.key, pk.key) DESC, length(k.key), position) AS rank FROM k JOIN pk ON contains(k.key, pk.key))
SELECT prefix_id, text, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def r13_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    texts = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("position"))
    prefixes = part.select(F.substring("p_name", 1, 3).alias("prefix")).distinct().select(F.col("prefix").alias("prefix_id"), "prefix")
    return search.rank_suggestions(prefixes, texts, 10)


@query(f"WITH {lq._GAPS} SELECT query_key, miss_count, last_seen_at FROM gap ORDER BY last_seen_at DESC, query_key LIMIT 20", "query_log")
def r18_recent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmart.operators.analytics import fold_search_gaps

    gaps = fold_search_gaps(view(spark, sf_dir, "query_log"), ("ts", "seq"))
    return gaps.orderBy(F.desc("last_seen_at"), "query_key").limit(20).select("query_key", "miss_count", "last_seen_at")


@query(
    f"""
WITH e AS (SELECT DISTINCT p_brand AS query_id, p_name AS query, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_name) AS candidate FROM part),
d AS (SELECT DISTINCT p_brand AS query_id, {sql_key("p_name")} AS key FROM part WHERE p_size < 10),
r AS (SELECT e.query_id, e.query, row_number() OVER (PARTITION BY e.query_id ORDER BY candidate) AS no FROM e ANTI JOIN d ON e.query_id = d.query_id AND {sql_key("e.query")} = d.key)
SELECT query_id, query, CAST(no AS INTEGER) AS no FROM r WHERE no <= 5"""
)
def u3_rescue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's names that haven't been searched."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_name").alias("query"), "p_size")
    expanded = part.select("query_id", "query").distinct().withColumn("candidate", F.dense_rank().over(Window.partitionBy("query_id").orderBy("query")))
    return results.rescue_queries(expanded, part.where(F.col("p_size") < 10), 5).select("query_id", "query", "no")


@query(
    """
WITH l AS (SELECT p_partkey AS line_id, p_brand AS b, p_name AS n FROM part),
w AS (SELECT line_id, string_split(concat(n, ' ', 'zz', line_id % 10), ' ') AS w FROM l)
SELECT line_id, w[1] AS brand_query, CASE WHEN len(w) > 2 THEN array_to_string(w[2:-2], ' ') END AS product_query, w[-1] AS shade_name FROM w"""
)
def f27_editor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 on names that end with a shade."""
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.concat("p_name", F.lit(" zz"), (F.col("p_partkey") % 10).cast("string")).alias("line"))
    return lines.select("line_id", editor.parse_line(F.col("line")).alias("p")).select("line_id", "p.brand_query", "p.product_query", "p.shade_name")


@query(
    f"""
WITH q AS (SELECT DISTINCT concat_ws(' ', p_name, split_part(p_type, ' ', 1)) AS query_id FROM part),
d AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 300 END AS grp, {sql_key("concat_ws(' ', p_name, p_type)", True)} AS t FROM part),
k AS (SELECT query_id, {sql_key("query_id", True)} AS key, list_distinct(list_transform(regexp_extract_all(query_id, '[0-9A-Za-z가-힣]+'), lambda w: lower(w))) AS toks FROM q),
h AS (SELECT query_id, p_partkey, grp FROM k JOIN d ON contains(t, key) OR len(list_filter(toks, lambda w: contains(t, w))) = len(toks))
SELECT query_id, p_partkey AS key FROM h UNION SELECT h.query_id, d.p_partkey FROM h JOIN d ON h.grp = d.grp"""
)
def j9_search_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    asked = part.select(F.concat_ws(" ", "p_name", F.split_part("p_type", F.lit(" "), F.lit(1))).alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    catalog = part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 300).alias("grp"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return matching.search_catalog(asked, catalog, "text", "p_partkey", "grp")


@query(
    f"""
WITH q AS (SELECT DISTINCT p_name AS query, p_brand FROM part),
p AS (SELECT q.query, q.p_brand, d.p_partkey AS id, d.p_size AS quality, {sql_key("concat_ws(' ', d.p_brand, d.p_name, d.p_type)", True)} AS h, {sql_key("q.query", True)} AS key,
   list_transform(regexp_extract_all(q.query, '[0-9A-Za-z가-힣]+'), lambda w: lower(w)) AS toks FROM q JOIN part d ON q.p_brand = d.p_brand),
s AS (SELECT *, list_filter(toks, lambda w: length(w) >= 2 AND NOT regexp_matches(w, 'gray|grey|brown|pink|peach')) AS dist, len(list_filter(toks, lambda w: length(w) >= 2 AND contains(h, w))) AS met FROM p),
g AS (SELECT *, len(list_filter(dist, lambda w: contains(h, w))) AS dm, len(dist) AS n FROM s),
z AS (SELECT query, p_brand, id, quality, CASE WHEN (n >= 2 AND dm >= greatest(2, n - 1)) OR (n = 1 AND dm = 1) OR n = 0 THEN CASE WHEN contains(h, key) THEN 100 ELSE 0 END + 10 * met ELSE 0 END AS match_score, n >= 2 AS strict FROM g),
t AS (SELECT *, max(match_score) OVER (PARTITION BY query, p_brand) AS top FROM z)
SELECT query, p_brand, id, CAST(match_score AS INTEGER) AS match_score, CAST(row_number() OVER (PARTITION BY query, p_brand ORDER BY match_score DESC, CASE WHEN top > 0 THEN -quality END, id) AS INTEGER) AS rank
FROM t WHERE match_score > 0 OR (top <= 0 AND NOT strict)"""
)
def r8_match_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand asked for among its parts."""
    part = read(spark, sf_dir, "part")
    asked = part.select(F.col("p_name").alias("product_query"), F.col("p_brand").alias("asked_brand")).distinct()
    docs = part.select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("quality_score"), F.lit(10).alias("source_priority"))
    haystack = ["brand", "name", "category"]
    asked, docs = matching.with_query_classes(spread(asked)), matching.with_haystack(spread(docs), haystack)
    pairs = asked.join(docs, asked["asked_brand"] == docs["brand"]).withColumn("query_id", F.concat_ws("|", "product_query", "asked_brand"))
    ranked = matching.rank_matches(matching.match_scores(pairs, haystack))
    return ranked.select(F.col("product_query").alias("query"), F.col("asked_brand").alias("p_brand"), F.col("index").alias("id"), "match_score", "rank")


# ---- streams


@query(
    """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM query_log),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS searches FROM s GROUP BY user_id, no""",
    "query_log",
)
def t6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lq._drained(spark, query_log.sessions(lq._stream(spark, sf_dir)), "complete")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "searches")


@query(
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS searches, count(*) FILTER (result_count > 0) / count(*) AS hit_ratio FROM query_log GROUP BY 1",
    "query_log",
)
def t3_streaming_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lq._drained(spark, query_log.windowed_latency(lq._stream(spark, sf_dir)), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "searches", "hit_ratio")


@query(cq.ORACLE_SQL["a1_upsert_products"])
def t5_streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: line items as a stream, joined with their parts, upserted batch by batch; the last version of the table."""
    path = f"{sf_dir}/lineitem.parquet"
    flow = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if lq._is_folder(spark, path) else f"{path}*")
    stream = cq.keyed_observations(spark, sf_dir, lineitem=flow).drop("query_key")
    where = fresh_path(spark, "upsert")
    writer = query_log.upsert_stream(stream, lambda current, batch: upsert.upsert_onto(current, batch, cq.ORDER), f"{where}/table", f"{where}/checkpoint")
    run = writer.start()
    run.awaitTermination()
    table = spark.read.parquet(f"{where}/table/v{run.lastProgress['batchId'] if run.lastProgress else 0}")
    return table.select("record_key", *cq._KNOWN, "source", "sale_price", "first_seen_at", "last_seen_at")
