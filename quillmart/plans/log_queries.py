"""Registered queries over the query log, jobs, decisions, offers and quality, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions import text
from quillmart.operators import analytics, jobs, matches, merge, quality, upsert
from quillmart.plans import catalog_queries as cq
from quillmart.plans.views import sql_key, view, with_views
from quillmart.shared import fresh_path
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


QKEY = sql_key("query")

_GAPS = f"""
g AS (SELECT *, {QKEY} AS query_key, CASE WHEN result_count = 0 THEN 'empty_result' ELSE 'low_result_count' END AS reason, row(ts, seq) AS rnk
      FROM query_log WHERE result_count < 8 AND {QKEY} <> ''),
gap AS (SELECT query_key, arg_max(trim(query), rnk) AS query, arg_max(result_count, rnk) AS result_count, count(*) AS miss_count,
        arg_max(reason, rnk) AS last_reason, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM g GROUP BY query_key)"""


@query(f"WITH {_GAPS} SELECT * FROM gap", "query_log")
def a10_search_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.fold_search_gaps(view(spark, sf_dir, "query_log"), ("ts", "seq"))


@query(
    f"""
WITH c AS (SELECT {QKEY} AS key, count(*) AS uses, arg_max(trim(query), row(ts, seq)) AS query, max(row(ts, seq)) AS last FROM query_log GROUP BY 1),
p AS (SELECT 'popular' AS kind, row_number() OVER (ORDER BY uses DESC, key) AS rank, query, uses FROM c),
r AS (SELECT 'recent' AS kind, row_number() OVER (ORDER BY last DESC) AS rank, query, uses FROM c)
SELECT kind, CAST(rank AS INTEGER) AS rank, query, uses FROM (SELECT * FROM p UNION ALL SELECT * FROM r) WHERE rank <= 10""",
    "query_log",
)
def a20_query_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.query_popularity(view(spark, sf_dir, "query_log"), ("ts", "seq"), 10)


@query(
    """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts DESC, seq DESC) AS rn FROM query_log)
SELECT query, count(*) AS search_count, count(*) FILTER (failed) AS search_failures, CAST(sum(result_count) AS BIGINT) AS result_count_total,
       count(*) FILTER (result_count > 0) AS index_hits, quantile_cont(elapsed_ms, 0.5) FILTER (rn <= 200) AS p50,
       quantile_cont(elapsed_ms, 0.95) FILTER (rn <= 200) AS p95, count(*) FILTER (rn <= 200) AS sample_count
FROM l GROUP BY query""",
    "query_log",
)
def a21_search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.search_metrics(view(spark, sf_dir, "query_log"), ["query"], ["ts", "seq"])


@query(
    f"""
WITH o AS (SELECT *, {cq.RECORD_KEY} AS record_key, {sql_key("category")} AS query_key FROM listing_obs)
SELECT count(DISTINCT record_key) AS product_count, max(observed_at) AS last_refreshed_at, count(DISTINCT query_key) AS query_count,
       count(DISTINCT row(canonical_product_id, source, source_product_id)) FILTER (canonical_product_id IS NOT NULL AND source_product_id IS NOT NULL) AS offer_count
FROM o""",
    "listing_obs",
)
def a8_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = cq.keyed_observations(spark, sf_dir)
    products = upsert.upsert_products(obs, cq.ORDER)
    offers, _ = upsert.upsert_offers(obs, cq.ORDER)
    return analytics.index_stats(products, obs, offers)


@query(
    """
SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  max(finished_at) AS last_finished_at, arg_max(last_error, row(updated_at, id)) FILTER (last_error IS NOT NULL) AS last_error FROM jobs""",
    "jobs",
)
def a9_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_stats(view(spark, sf_dir, "jobs"))


@query(
    """
WITH c AS (SELECT id FROM jobs WHERE status IN ('pending', 'failed') AND attempt_count < max_attempts ORDER BY priority, last_seen_at NULLS FIRST, id LIMIT 100)
SELECT jobs.id, priority, CASE WHEN c.id IS NOT NULL THEN 'running' ELSE status END AS status,
  CAST(attempt_count + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempt_count, c.id IS NOT NULL AS claimed
FROM jobs LEFT JOIN c ON jobs.id = c.id""",
    "jobs",
)
def m10_claim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim_jobs(view(spark, sf_dir, "jobs"), 100).select("id", "priority", "status", "attempt_count", "claimed")


@query(
    """
SELECT id, status = 'running' AND started_at < TIMESTAMP '1995-06-01' AS reset,
  CASE WHEN status = 'running' AND started_at < TIMESTAMP '1995-06-01' THEN CASE WHEN attempt_count < max_attempts THEN 'pending' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN status = 'running' AND started_at < TIMESTAMP '1995-06-01' THEN 'stale running job reset after 60 minutes' ELSE last_error END AS last_error FROM jobs""",
    "jobs",
)
def m12_reset_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    return jobs.reset_stale(view(spark, sf_dir, "jobs"), cutoff, 60).select("id", "reset", "status", "last_error")


_ASKED = "SELECT concat('Search! ', CAST(o_custkey % 3 AS varchar(20))) AS kind, CAST(o_orderkey % 500 AS varchar(20)) AS query, CAST(o_custkey % 50 AS int) AS priority, CAST(o_custkey % 6 AS int) AS max_attempts, o_orderkey AS position FROM orders"
_KNOWN_JOBS = "SELECT concat('search-', CAST(o_orderkey % 3 AS varchar(20)), ':', CAST(o_orderkey AS varchar(20))) AS job_key, concat('search-', CAST(o_orderkey % 3 AS varchar(20))) AS kind, CAST(o_orderkey AS varchar(20)) AS query, 20 AS priority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, CAST(o_custkey % 4 AS int) AS attempt_count, 3 AS max_attempts FROM orders WHERE o_orderkey < 400"


@query(
    f"""
WITH a AS ({_ASKED}), k AS ({_KNOWN_JOBS}),
r AS (SELECT concat(regexp_replace(lower(kind), '[^0-9a-z:_-]+', '-', 'g'), ':', query) AS job_key, min(regexp_replace(lower(kind), '[^0-9a-z:_-]+', '-', 'g')) AS rkind,
      arg_max(query, position) AS rquery, min(priority) AS rpriority, max(greatest(max_attempts, 1)) AS rmax FROM a GROUP BY 1)
SELECT coalesce(k.job_key, r.job_key) AS job_key, coalesce(kind, rkind) AS kind, coalesce(rquery, query) AS query, least(priority, rpriority) AS priority,
       CASE WHEN status IN ('completed', 'running') OR rquery IS NULL THEN status ELSE 'pending' END AS status, coalesce(attempt_count, 0) AS attempt_count,
       greatest(max_attempts, rmax) AS max_attempts
FROM k FULL JOIN r ON k.job_key = r.job_key"""
)
def m9_enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = spark.sql(_ASKED.replace("FROM orders", "FROM {orders}"), orders=orders)
    known = spark.sql(_KNOWN_JOBS.replace("FROM orders", "FROM {orders}"), orders=orders)
    return jobs.enqueue_jobs(known, asked)


# ---- matches


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 10 != 0)
    return customers.select(F.concat(F.lit("match:"), F.col("c_custkey").cast("string")).alias("match_id"), F.lit("pending_review").alias("review_state"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "decisions").withColumn("match_id", F.concat(F.lit("match:"), F.col("match_no").cast("string")))


@query(
    """
WITH m AS (SELECT concat('match:', CAST(c_custkey AS varchar(20))) AS match_id FROM customer WHERE c_custkey % 10 <> 0),
d AS (SELECT concat('match:', CAST(match_no AS varchar(20))) AS match_id, seq, decision, reviewer,
      lag(decision) OVER (PARTITION BY match_no ORDER BY decided_at, seq) AS before FROM decisions)
SELECT d.match_id, seq, decision, reviewer, CASE WHEN m.match_id IS NOT NULL THEN coalesce(before, 'pending_review') END AS previous_state,
  CASE WHEN m.match_id IS NULL THEN 'not_found' WHEN coalesce(before, 'pending_review') = decision THEN 'noop' ELSE 'updated' END AS outcome
FROM d LEFT JOIN m ON d.match_id = m.match_id""",
    "decisions",
)
def m4_apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = matches.apply_reviews(ledger(spark, sf_dir), decisions(spark, sf_dir), ("decided_at", "seq"))
    return done.select("match_id", "seq", "decision", "reviewer", "previous_state", "outcome")


@query(
    """
WITH m AS (SELECT concat('match:', CAST(c_custkey AS varchar(20))) AS match_id FROM customer WHERE c_custkey % 10 <> 0),
d AS (SELECT concat('match:', CAST(match_no AS varchar(20))) AS match_id, * FROM decisions)
SELECT m.match_id, count(seq) AS n_events, min(decided_at) AS first_at, arg_max(decision, row(decided_at, seq)) AS last_decision
FROM m LEFT JOIN d ON m.match_id = d.match_id GROUP BY m.match_id""",
    "decisions",
)
def m6_match_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = decisions(spark, sf_dir).select("match_id", "decided_at", "seq", "decision", "reviewer")
    told = matches.with_history(ledger(spark, sf_dir), events, ("decided_at", "seq"))
    return told.select("match_id", F.size("history").cast("long").alias("n_events"), F.try_element_at("history.decided_at", F.lit(1)).alias("first_at"), F.try_element_at("history.decision", F.lit(-1)).alias("last_decision"))


_OFFERS = """
of AS (SELECT DISTINCT canonical_product_id, source, source_product_id, concat(canonical_product_id, ':', source, ':', source_product_id) AS offer_id FROM listing_obs
       WHERE canonical_product_id IS NOT NULL AND source_product_id IS NOT NULL),
mt AS (SELECT concat('match:', canonical_product_id, ':', source, ':', source_product_id) AS match_id, canonical_product_id, offer_id, 0.5 AS confidence, 'title' AS match_method,
       CASE source WHEN 'musinsa' THEN 'verified' WHEN 'official' THEN 'rejected' ELSE 'pending_review' END AS review_state,
       CASE source WHEN 'musinsa' THEN 'clerk' END AS reviewed_by FROM of WHERE source IN ('musinsa', 'official', 'coupang'))"""


def offers_and_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = cq.observations(spark, sf_dir).where(F.col("canonical_product_id").isNotNull() & F.col("source_product_id").isNotNull())
    offers = obs.select("canonical_product_id", "source", "source_product_id").distinct().withColumn("offer_id", F.concat_ws(":", "canonical_product_id", "source", "source_product_id"))
    source = F.col("source")
    state = F.when(source == "musinsa", "verified").when(source == "official", "rejected").otherwise("pending_review")
    known = offers.where(source.isin("musinsa", "official", "coupang")).select(
        F.concat(F.lit("match:"), F.col("offer_id")).alias("match_id"), "canonical_product_id", "offer_id", F.lit(0.5).alias("confidence"), F.lit("title").alias("match_method"),
        state.alias("review_state"), F.when(source == "musinsa", "clerk").alias("reviewed_by"),
    )
    return offers, known


@query(
    f"""
WITH {_OFFERS},
c AS (SELECT l.canonical_product_id, o.offer_id, (seq % 100) / 100.0 AS confidence, 'embedding' AS match_method, {cq.SQL_ORDER} AS rnk
      FROM listing_obs l JOIN of o ON l.canonical_product_id = o.canonical_product_id AND l.source = o.source AND l.source_product_id = o.source_product_id WHERE l.seq % 3 = 0),
b AS (SELECT concat('match:', offer_id) AS match_id, arg_max(canonical_product_id, rnk) AS cc, arg_max(offer_id, rnk) AS co, arg_max(confidence, rnk) AS cf, arg_max(match_method, rnk) AS cm FROM c GROUP BY 1)
SELECT coalesce(mt.match_id, b.match_id) AS match_id, coalesce(canonical_product_id, cc) AS canonical_product_id, coalesce(offer_id, co) AS offer_id,
  CAST(CASE WHEN coalesce(review_state, 'pending_review') = 'pending_review' AND cf IS NOT NULL THEN cf ELSE confidence END AS DOUBLE) AS confidence,
  CASE WHEN coalesce(review_state, 'pending_review') = 'pending_review' AND cf IS NOT NULL THEN cm ELSE match_method END AS match_method,
  coalesce(review_state, 'pending_review') AS review_state, reviewed_by
FROM mt FULL JOIN b ON mt.match_id = b.match_id""",
    "listing_obs",
)
def m1_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = offers_and_matches(spark, sf_dir)
    rows = cq.observations(spark, sf_dir).where(F.col("seq") % 3 == 0)
    made = rows.select(
        "canonical_product_id", F.concat(F.col("canonical_product_id"), F.lit(":"), F.col("source"), F.lit(":"), F.col("source_product_id")).alias("offer_id"),
        (F.col("seq") % 100 / 100.0).alias("confidence"), F.lit("embedding").alias("match_method"), *cq.ORDER,
    )
    return matches.merge_candidates(known, made, offers, cq.ORDER)


@query(
    f"""
WITH {_OFFERS}
SELECT match_id, canonical_product_id, offer_id, CAST(confidence AS DOUBLE) AS confidence, match_method, review_state, reviewed_by FROM mt
UNION ALL SELECT concat('match:', offer_id), canonical_product_id, offer_id, 1.0, 'verified_catalog', 'verified', 'import' FROM of WHERE source NOT IN ('musinsa', 'official', 'coupang')""",
    "listing_obs",
)
def m2_backfill_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, known = offers_and_matches(spark, sf_dir)
    return matches.backfill_verified(known, offers, "import")


@query(
    """
SELECT o_custkey AS match_no, o_orderkey AS seq, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'state' WHEN o_orderstatus = 'F' AND o_custkey % 4 = 0 THEN 'reviewer' END AS violation
FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR (o_orderstatus = 'F' AND o_custkey % 4 = 0)"""
)
def m8_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.col("o_orderstatus")
    rows = orders.select(
        F.col("o_custkey").alias("match_no"), F.col("o_orderkey").alias("seq"), F.when(status == "F", "verified").when(status == "O", "rejected").otherwise("odd").alias("review_state"),
        F.when(F.col("o_custkey") % 4 != 0, "clerk").otherwise(" ").alias("reviewed_by"),
    )
    return matches.violations(rows).select("match_no", "seq", "violation")


# ---- offers of products, quality

_OFFER_FIELDS = ("source", "source_product_id", "source_url", "price", "original_price", "sale_price", "image_url", "updated_at", "review_state", "source_priority")


@query(
    f"""
WITH x AS (SELECT part_no, source, source_product_id, source_url, tie AS price, original_price, sale_price, CASE WHEN seq % 11 = 0 THEN 'verified' END AS review_state, {cq.SQL_ORDER} AS rnk,
   concat(source, ':', coalesce(source_product_id, source_url)) AS offer_key FROM listing_obs),
r AS (SELECT *, row_number() OVER (PARTITION BY part_no, offer_key ORDER BY review_state IS NULL,
   (source_product_id IS NOT NULL)::int + (sale_price IS NOT NULL)::int DESC, rnk) AS rn FROM x)
SELECT part_no, offer_key, source, price, sale_price, review_state FROM r WHERE rn = 1""",
    "listing_obs",
)
def a6_merge_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = cq.observations(spark, sf_dir).withColumns({"price": F.col("tie"), "review_state": F.when(F.col("seq") % 11 == 0, "verified"), "image_url": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("string")})
    return merge.merge_offer_rows(obs, ["part_no"], cq.ORDER).select("part_no", "offer_key", "source", "price", "sale_price", "review_state")


_BARE = lambda c: f"lower(regexp_replace(coalesce({c}, ''), '[^0-9A-Za-z가-힣]+', '', 'g'))"
_BEFORE = lambda b: f"({_BARE(b)} <> '' AND {_BARE('d')} <> {_BARE(b)} AND starts_with({_BARE('d')}, {_BARE(b)}))"
_ISSUE_SQL = rf"""
p AS (SELECT *, coalesce(product_name_display_ko, '') AS d, list_filter([CASE WHEN brand_en IS NULL THEN 'brand_en' END, CASE WHEN product_name_en IS NULL THEN 'product_name_en' END,
   CASE WHEN price IS NULL THEN 'price' END, CASE WHEN image_url IS NULL THEN 'image_url' END], lambda x: x IS NOT NULL) AS missing FROM judged),
i AS (SELECT seq, source, unnest(list_concat(list_filter([
   CASE WHEN product_name_ko IS NULL AND product_name_en IS NULL THEN 'required:missing_product_name' END,
   CASE WHEN source = '' THEN 'required:missing_source' END,
   CASE WHEN source_url IS NULL AND source_product_id IS NULL THEN 'required:missing_source_locator' END,
   CASE WHEN contains(d, '[') OR contains(d, ']') OR contains(d, '기획') OR contains(d, '단품') OR contains(d, '택1') OR contains(d, 'Colors') OR contains(d, 'colors') OR contains(d, '종')
     OR contains(d, '(') OR contains(d, ')') THEN 'display:dirty_display_name' END,
   CASE WHEN regexp_matches(d, '(?i)(^|\s)SPF\s*[0-9]+\+?\s*,?(\s*/\s*PA\+{{1,4}}|\s+PA\+{{1,4}}|\s*,\s*PA\+{{1,4}})?(\s+\S.*)?$') THEN 'display:dirty_display_sun_protection_suffix'
        WHEN regexp_matches(d, '(?i)[0-9]+(\.[0-9]+)?\s*(g|ml)\s*([*x]\s*[0-9]+\s*(ea|입)?|\+\s*[0-9]+(\.[0-9]+)?\s*(g|ml)(\s+\S.*)?|\+\s*\S+)\s*$') THEN 'display:dirty_display_bundle_suffix'
        WHEN regexp_matches(d, '(?i)[0-9]+(\.[0-9]+)?\s*(g|ml)\s*(\*[a-z가-힣0-9\s*]+|\s+증량)\s*$') THEN 'display:dirty_display_volume_descriptor_suffix' END,
   CASE WHEN {_BEFORE('brand_ko')} OR {_BEFORE('brand_en')} THEN 'display:brand_prefixed_display_name' END], lambda x: x IS NOT NULL),
   list_transform(missing, lambda f: concat('enrichment:missing_', f)))) AS issue FROM p)"""


@query(f"WITH {_ISSUE_SQL} SELECT source, issue, count(*) AS n FROM i GROUP BY ALL", "judged")
def a13_quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = quality.quality_issues(view(spark, sf_dir, "judged"), "seq")
    return issues.groupBy("source", F.concat_ws(":", "severity", "issue").alias("issue")).agg(F.count(F.lit(1)).alias("n"))


_SCORE = """(CASE WHEN product_name_ko IS NOT NULL OR product_name_en IS NOT NULL THEN 30 ELSE 0 END) + (CASE WHEN source <> '' THEN 20 ELSE 0 END) + (CASE WHEN source_url IS NOT NULL OR source_product_id IS NOT NULL THEN 20 ELSE 0 END)
  + (CASE WHEN brand_ko IS NOT NULL THEN 10 ELSE 0 END) + (CASE WHEN brand_en IS NOT NULL THEN 8 ELSE 0 END) + (CASE WHEN product_name_en IS NOT NULL THEN 8 ELSE 0 END) + (CASE WHEN price IS NOT NULL THEN 5 ELSE 0 END)
  + (CASE WHEN image_url IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN rating IS NOT NULL THEN 4 ELSE 0 END)"""


@query(
    f"""
WITH {_ISSUE_SQL},
t AS (SELECT count(*) AS total, count(product_name_en) AS product_name_en, count(*) FILTER (product_name_ko IS NOT NULL AND d <> '' AND product_name_ko <> d) AS display_cleaned,
   count(override_ko) AS display_ko_override, count(override_en) AS display_en_override, round(avg({_SCORE}), 2) AS mean_quality FROM p),
m AS (SELECT unnest(['total', 'product_name_en', 'display_cleaned', 'display_ko_override', 'display_en_override', 'mean_quality']) AS name,
   unnest([CAST(total AS DOUBLE), product_name_en, display_cleaned, display_ko_override, display_en_override, mean_quality]) AS value FROM t)
SELECT 'total' AS measure, name, value FROM m
UNION ALL SELECT 'total', concat(split_part(issue, ':', 1), '_issues'), CAST(count(*) AS DOUBLE) FROM i GROUP BY 2
UNION ALL SELECT 'source', split_part(source, ':', 1), CAST(count(*) AS DOUBLE) FROM p GROUP BY 2
UNION ALL SELECT 'missing_field', f, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(missing) AS f FROM p) GROUP BY 2""",
    "judged",
)
def a12_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(view(spark, sf_dir, "judged"))


@query(
    """
SELECT c_custkey AS id, (CASE WHEN c_custkey % 5 <> 0 THEN 30 ELSE 0 END) + 20 + (CASE WHEN c_custkey % 7 <> 0 THEN 20 ELSE 0 END) + (CASE WHEN c_custkey % 3 <> 0 THEN 8 ELSE 0 END)
  + (CASE WHEN c_custkey % 5 <> 0 THEN 8 ELSE 0 END) + 5 + (CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END) + (CASE WHEN c_custkey % 11 = 0 THEN 4 ELSE 0 END) AS score,
  list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'brand_en' END, CASE WHEN c_custkey % 5 = 0 THEN 'product_name_en' END, CASE WHEN c_custkey % 2 <> 0 THEN 'image_url' END], lambda x: x IS NOT NULL) AS missing
FROM customer"""
)
def n6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6, N7."""
    n = F.col("c_custkey")
    none = F.lit(None).cast("string")
    c = {
        "product_name_ko": none, "product_name_en": F.when(n % 5 != 0, F.col("c_name")), "source": F.lit("s"), "source_url": F.when(n % 7 != 0, "u"), "source_product_id": none, "brand_ko": none,
        "brand_en": F.when(n % 3 != 0, "b"), "price": F.col("c_acctbal"), "image_url": F.when(n % 2 == 0, "i"), "rating": F.when(n % 11 == 0, 4.0), "review_count": F.lit(None).cast("int"),
    }
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(n.alias("id"), merge.quality_score(c).alias("score"), merge.missing_fields(c).alias("missing"))


# ---- streams, each held against its batch form


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as a stream of the events table, joined with its static names."""
    events = f"{sf_dir}/events.parquet"
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey"), F.col("p_name").alias("query"))
    flow = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events if _is_folder(spark, events) else f"{events}*")
    joined = flow.join(F.broadcast(names.where(F.col("p_partkey") < 100)), F.col("event_id") % 100 == F.col("p_partkey"))
    return joined.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "query", (F.floor("value").cast("long") % 12).alias("result_count"), F.col("value").alias("elapsed_ms"), (F.col("event_type") == "error").alias("failed")
    )


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return query_log.drained(stream, fresh_path(spark, "stream"), mode)


@query(
    f"""
WITH {_GAPS} SELECT query_key, query, result_count, miss_count, last_reason FROM gap""",
    "query_log",
)
def t1_streaming_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(spark, query_log.running_gaps(_stream(spark, sf_dir)), "complete")
    return rows.select("query_key", "query", "result_count", "miss_count", "last_reason")


@query(
    f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, {QKEY} AS query_key, count(*) AS uses FROM query_log GROUP BY ALL""",
    "query_log",
)
def t2_streaming_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(spark, query_log.windowed_popularity(_stream(spark, sf_dir)), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "query_key", "uses")
