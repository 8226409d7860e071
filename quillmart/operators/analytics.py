"""Tables over the query log: gaps, popularity, recency, latency; index statistics and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.text import clean_text, search_key, source_from_url


def gap_threshold(limit: int) -> int:
    """Results below which a search is a gap; none for searches of one result."""
    return 0 if limit <= 1 else min(limit, 8)


def gap_reason(result_count: Column) -> Column:
    return F.when(result_count == 0, "empty_result").otherwise("low_result_count")


def gaps_only(log: DataFrame, limit: int) -> DataFrame:
    """Searches of the log that are gaps, with ``query_key`` and ``reason``."""
    keyed = log.withColumn("query_key", search_key(F.col("query"))).where((F.col("query_key") != "") & (F.col("result_count") < gap_threshold(limit)))
    return keyed.withColumn("reason", gap_reason(F.col("result_count")))


def fold_search_gaps(log: DataFrame, order: Sequence[str], limit: int = 24, time_col: str = "ts") -> DataFrame:
    """A10: one row for each query key: misses, last text, count and reason, first and last time."""
    last = F.max_by(F.struct(F.trim("query").alias("query"), F.greatest("result_count", F.lit(0)).alias("result_count"), "reason"), F.struct(*order))
    out = gaps_only(log, limit).groupBy("query_key").agg(F.count(F.lit(1)).alias("miss_count"), last.alias("l"), F.min(time_col).alias("first_seen_at"), F.max(time_col).alias("last_seen_at"))
    return out.select("query_key", "l.query", "l.result_count", "miss_count", F.col("l.reason").alias("last_reason"), "first_seen_at", "last_seen_at")


def query_popularity(log: DataFrame, order: Sequence[str], k: int = 10) -> DataFrame:
    """``(kind, rank, query, uses)``: the ``k`` most frequent and the ``k`` most recent queries, by key, with their last text."""
    rank = F.struct(*order)
    keyed = log.select(clean_text(F.col("query")).alias("label"), search_key(F.col("query")).alias("key"), *order).where(F.col("key") != "")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.max_by("label", rank).alias("query"), F.max(rank).alias("last"))
    out = []
    for kind, orders in (("popular", [F.desc("uses"), F.asc("key")]), ("recent", [F.desc("last")])):
        # The top k are taken before they are numbered, so one task numbers k rows.
        top = counts.orderBy(*orders).limit(k)
        out.append(top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*orders)).alias("rank"), "query", "uses"))
    return out[0].unionByName(out[1])


def search_metrics(log: DataFrame, group: Sequence[str], order: Sequence[str], window: int = 200) -> DataFrame:
    """Counters, and the 50th and 95th percentile of the last ``window`` latencies of each group."""
    last = Window.partitionBy(*group).orderBy(*(F.col(o).desc() for o in order))
    recent = log.withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") <= window)
    shares = F.percentile("elapsed_ms", F.array(F.lit(0.5), F.lit(0.95)))
    latency = recent.groupBy(*group).agg(shares.alias("p"), F.count(F.lit(1)).alias("sample_count"))
    counters = log.groupBy(*group).agg(
        F.count(F.lit(1)).alias("search_count"), F.count_if(F.col("failed")).alias("search_failures"), F.sum("result_count").alias("result_count_total"), F.count_if(F.col("result_count") > 0).alias("index_hits")
    )
    return counters.join(latency, list(group)).select(*group, "search_count", "search_failures", "result_count_total", "index_hits", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "sample_count")


def index_stats(products: DataFrame, ranks: DataFrame, offers: DataFrame) -> DataFrame:
    """One row of counts and last times; each table is aggregated on its own."""
    p = products.agg(F.count(F.lit(1)).alias("product_count"), F.max("last_seen_at").alias("last_refreshed_at"))
    q = ranks.agg(F.count_distinct("query_key").alias("query_count"))
    o = offers.agg(F.count(F.lit(1)).alias("offer_count"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(p).join(one(q), "__one").join(one(o), "__one").drop("__one")


def _judged(queries: DataFrame, results: DataFrame) -> DataFrame:
    hits = results.select("query_id").distinct().withColumn("hit", F.lit(True))
    return queries.select("group", "query_id").join(hits, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def coverage_backtest(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per group of ``queries (group, query_id)`` how many have a result: ``total, passed, pass_rate``."""
    total, passed = F.count(F.lit(1)), F.count_if(F.col("hit"))
    return _judged(queries, results).groupBy("group").agg(total.alias("total"), passed.alias("passed"), (passed / total).alias("pass_rate"))


def failed_queries(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(group, query_id)`` of the queries without a result, a row each, so a group may have any number of them."""
    return _judged(queries, results).where(~F.col("hit")).select("group", "query_id")


def check_expectations(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Each expected first result with what came first, and whether they are equal. ``results`` has ``query_id, rank, name``."""
    first = results.where(F.col("rank") == 1).select("query_id", F.col("name").alias("found"))
    return expected.join(first, "query_id", "left").withColumn("passed", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def ingestion_summary(jobs: DataFrame) -> DataFrame:
    """Queries, products, stored and failed of a run, by run."""
    return jobs.groupBy("run").agg(F.count(F.lit(1)).alias("queries"), F.sum("product_count").alias("products"), F.sum("stored_count").alias("stored"), F.count_if(F.col("error").isNotNull()).alias("failures"))


def catalog_stats(items: DataFrame) -> DataFrame:
    """``(measure, n)``: rows of a catalog, those with a canonical id and with an English name, and rows of each source.

    ``items`` has ``source, source_url, canonical_product_id, product_name_en`` and the array ``offer_sources``. A row counts
    once for its source (the part before the colon; where it has none, the source its URL belongs to) and for each
    source of its offers. One pass, aggregated in each task. An empty catalog has the three totals, all 0.
    """
    family = lambda c: F.nullif(F.substring_index(c, ":", 1), F.lit(""))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    own = F.coalesce(F.when(filled("source"), family(F.col("source"))), F.when(~filled("source"), source_from_url(F.col("source_url"))))
    offered = F.transform(F.coalesce("offer_sources", F.array().cast("array<string>")), family)
    sources = F.array_compact(F.array_distinct(F.concat(F.array(own), offered)))
    totals = F.array(F.lit("total"), F.when(filled("canonical_product_id"), "canonical_product_id"), F.when(filled("product_name_en"), "product_name_en"))
    measures = F.concat(F.array_compact(totals), F.transform(sources, lambda s: F.concat(F.lit("source:"), s)))
    counts = items.select(F.explode(measures).alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
    always = items.sparkSession.createDataFrame([("total",), ("canonical_product_id",), ("product_name_en",)], "measure string")
    return always.join(counts, "measure", "full").select("measure", F.coalesce("n", F.lit(0)).alias("n"))
