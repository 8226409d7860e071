"""The table of collection jobs: enqueue, claim, complete, reset, and the gaps that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.keys import job_key, job_kind
from quillmart.functions.text import clean_text, search_key

DONE = ("completed", "failed", "skipped")


def enqueue_jobs(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """M9: the table after requests ``(kind, query, priority, max_attempts, position)``.

    Requests of one key count as one: the last text, the least priority, the most attempts. A new key is pending; of a
    known one completed and running stay, other states become pending again. ``jobs`` has ``job_key, kind, query,
    priority, status, attempt_count, max_attempts``.
    """
    keyed = asked.where(search_key(F.col("query")) != "").withColumn("job_key", job_key(F.col("kind"), F.col("query")))
    one = keyed.groupBy("job_key").agg(
        F.max_by(F.trim("query"), "position").alias("__query"),
        F.first(job_kind(F.col("kind"))).alias("__kind"),
        F.min(F.greatest("priority", F.lit(0))).alias("__priority"),
        F.max(F.greatest("max_attempts", F.lit(1))).alias("__max"),
    )
    both = jobs.join(one, "job_key", "full")
    kept = F.col("status").isin("completed", "running") | F.col("__query").isNull()
    return both.select(
        "job_key",
        F.coalesce("kind", "__kind").alias("kind"),
        F.coalesce("__query", "query").alias("query"),
        F.least("priority", "__priority").alias("priority"),
        F.when(kept, F.col("status")).otherwise("pending").alias("status"),
        F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
        F.greatest("max_attempts", "__max").alias("max_attempts"),
    )


def claim_jobs(jobs: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """The table with the next ``limit`` open jobs running: least priority, longest unseen, then least id.

    ``claimed`` tells them. The choice is a top-k of ids, which is as small as ``limit``.
    """
    open_ = jobs.where(F.col("status").isin("pending", "failed") & (F.col("attempt_count") < F.col("max_attempts")))
    if kind is not None:
        open_ = open_.where(F.col("kind") == job_kind(F.lit(kind)))
    chosen = open_.orderBy("priority", F.asc_nulls_first("last_seen_at"), "id").limit(max(limit, 0)).select("id", F.lit(True).alias("claimed"))
    marked = jobs.join(chosen, "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return marked.withColumns({
        "status": F.when(F.col("claimed"), "running").otherwise(F.col("status")),
        "attempt_count": F.col("attempt_count") + F.col("claimed").cast("int"),
    })


def complete_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The table after ``results (id, new_status, new_count, new_error, at)``; unknown states count as failed.

    Of several results of one job the last one holds. Jobs without a result stay as they are, their count too; those with
    one are seen and updated at its time. The columns that ``jobs`` lacks of those are added.
    """
    last = results.groupBy("id").agg(F.max_by(F.struct("new_status", "new_count", "new_error"), "at").alias("r"), F.max("at").alias("at"))
    both = jobs.join(last, "id", "left")
    done = F.col("r").isNotNull()
    old = lambda c: F.col(c) if c in jobs.columns else F.lit(None)
    return both.withColumns({
        "status": F.when(done, F.when(F.col("r.new_status").isin(*DONE), F.col("r.new_status")).otherwise("failed")).otherwise(F.col("status")),
        "product_count": F.when(done, F.greatest(F.coalesce("r.new_count", F.lit(0)), F.lit(0))).otherwise(old("product_count")),
        "last_error": F.when(done, F.col("r.new_error")).otherwise(F.col("last_error")),
        **{c: F.when(done, F.col("at")).otherwise(old(c)) for c in ("finished_at", "last_seen_at", "updated_at")},
    }).drop("r", "at")


def reset_stale(jobs: DataFrame, cutoff, minutes: int) -> DataFrame:
    """Running jobs that began before ``cutoff`` (a column or literal) are pending again, or failed without attempts left."""
    stale = F.coalesce((F.col("status") == "running") & (F.col("started_at") < cutoff), F.lit(False))
    return jobs.withColumns({
        "last_error": F.when(stale, f"stale running job reset after {max(minutes, 1)} minutes").otherwise(F.col("last_error")),
        "status": F.when(stale, F.when(F.col("attempt_count") < F.col("max_attempts"), "pending").otherwise("failed")).otherwise(F.col("status")),
        "reset": stale,
    })


def job_stats(jobs: DataFrame) -> DataFrame:
    """One row: jobs by state (0 for none), the last finish, the error of the last update that had one."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed", "skipped")]
    error = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.struct("updated_at", "id")))
    return jobs.agg(F.count(F.lit(1)).alias("total"), *counts, F.max("finished_at").alias("last_finished_at"), error.alias("last_error"))


def gap_requests(gaps: DataFrame, aliases: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """The requests that search gaps make: their query, and the aliases of brands they touch; urgent where nothing was found."""
    from quillmart.operators.search import expand_aliases

    own = gaps.select(F.col("query_key").alias("query_id"), "query", F.when(F.col("last_reason") == "empty_result", 10).otherwise(20).alias("priority"))
    asked = own.withColumn("candidate", F.lit(0))
    if aliases is not None:
        asked = expand_aliases(own.select("query_id", "query"), aliases).join(own.select("query_id", "priority"), "query_id")
    return asked.select(F.lit("search").alias("kind"), clean_text(F.col("query")).alias("query"), "priority", F.lit(attempts).alias("max_attempts"), F.struct("query_id", "candidate").alias("position"))
