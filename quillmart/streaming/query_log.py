"""Structured Streaming over the query log: gaps, popularity, latency, sessions, suppression, upserts.

Windows, watermarks and lateness are this library's own; each batch counterpart is in ``operators``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions.text import search_key
from quillmart.operators.analytics import gaps_only

#: Seconds in which a query is refreshed once.
TTL = "180 seconds"


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_gaps(log: DataFrame, limit: int = 24, time_col: str = "ts") -> DataFrame:
    """The gap ledger as it grows (update mode); the state is one row a query key."""
    last = F.max_by(F.struct(F.trim("query").alias("query"), "result_count", "reason"), F.struct(time_col, "seq"))
    out = gaps_only(log, limit).groupBy("query_key").agg(F.count(F.lit(1)).alias("miss_count"), last.alias("l"), F.min(time_col).alias("first_seen_at"), F.max(time_col).alias("last_seen_at"))
    return out.select("query_key", "l.query", "l.result_count", "miss_count", F.col("l.reason").alias("last_reason"), "first_seen_at", "last_seen_at")


def windowed_popularity(log: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """Uses of each query key in tumbling or sliding windows."""
    keyed = log.withColumn("query_key", search_key(F.col("query"))).withWatermark(time_col, late)
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    out = keyed.groupBy(window.alias("w"), "query_key").agg(F.count(F.lit(1)).alias("uses"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "query_key", "uses")


def windowed_latency(log: DataFrame, size: str = "1 hour", late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """Approximate percentiles of latency, and the share of searches with results, by window."""
    out = log.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w")).agg(
        F.percentile_approx("elapsed_ms", [0.5, 0.95], 10_000).alias("p"), F.count(F.lit(1)).alias("searches"), F.count_if(F.col("result_count") > 0).alias("hits")
    )
    return out.select(F.col("w.start").alias("start"), F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "searches", (F.col("hits") / F.col("searches")).alias("hit_ratio"))


def refresh_requests(log: DataFrame, ttl: str = TTL, time_col: str = "ts") -> DataFrame:
    """T4: the first search of each query key within the time to live; the others are suppressed."""
    return log.withColumn("query_key", search_key(F.col("query"))).withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(["query_key"])


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """Searches of each user without a pause longer than ``gap``."""
    out = log.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("searches"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "searches")


def upsert_stream(stream: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], path: str, checkpoint: str):
    """T5: keep a folded table below ``path`` up to date: ``fold(current, batch)`` gives its next version.

    Every version is a folder of its own, ``v`` and the batch's number, so a batch that is tried again overwrites its own
    version only, from the same one before it. Returns the writer; ``start()`` it.
    """

    def step(batch: DataFrame, number: int) -> None:
        current = batch.sparkSession.read.parquet(f"{path}/v{number - 1}") if number else None
        fold(current, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what there is and return the rows it gave, from files below ``folder``: in complete mode those of
    its last batch, else those of all batches. Nothing passes through the driver."""
    numbers: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/v{number}")
        numbers.append(number)

    run = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    kept = numbers[-1:] if mode == "complete" else numbers
    return stream.sparkSession.read.schema(stream.schema).parquet(*(f"{folder}/out/v{n}" for n in dict.fromkeys(kept))) if kept else stream.sparkSession.createDataFrame([], stream.schema)
