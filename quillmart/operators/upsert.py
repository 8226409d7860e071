"""Folds of repeated observations: products, offers with link protection, query ranks, records of a collection.

Order is always an explicit tuple of columns (``order``), never the order of rows. A fold is one aggregation whose
partial results are merged before the shuffle, so a key with very many observations costs one small row a task. Where
nearly every key comes once, partial results are only longer than the rows (each column has its order tuple with it);
offers, and records that say so, are dealt as they are and folded after one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of which the latest row's value holds as it is, null or not.
AS_LATEST = ("source", "sale_price", "discount_rate", "search_text", "source_updated_at")


def _latest_known(name: str, order: Column) -> Column:
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name)


def _first_known(name: str, order: Column) -> Column:
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name)


def upsert_products(observations: DataFrame, order: Sequence[str], time_col: str = "observed_at", key_col: str | Sequence[str] = "record_key", as_latest: Sequence[str] = AS_LATEST) -> DataFrame:
    """A1: one row for each key, of one column or several. Columns keep their latest known value, those of ``as_latest`` the latest row's.

    ``first_seen_at`` and ``last_seen_at`` are the least and greatest ``time_col``; where rows have a ``first_seen_at``
    of their own, it counts. :func:`upsert_onto` goes on from a table that has been folded before.
    """
    rank = F.struct(*order)
    seen = ("first_seen_at", "last_seen_at")
    key = [key_col] if isinstance(key_col, str) else list(key_col)
    skip = {*key, *order, *seen}
    first = F.coalesce("first_seen_at", time_col) if "first_seen_at" in observations.columns else F.col(time_col)
    latest = [c for c in observations.columns if c in as_latest and c not in skip]
    known = [c for c in observations.columns if c not in as_latest and c not in skip]
    folded = [_latest_known(c, rank) for c in known]
    if latest:
        folded.append(F.max_by(F.struct(*latest), rank).alias("__latest"))
    out = observations.groupBy(*key).agg(*folded, F.min(first).alias("first_seen_at"), F.max(time_col).alias("last_seen_at"))
    return out.select(*key, *known, *(F.col(f"__latest.{c}").alias(c) for c in latest), "first_seen_at", "last_seen_at")


def upsert_onto(current: DataFrame | None, batch: DataFrame, order: Sequence[str], time_col: str = "observed_at", key_col: str = "record_key", as_latest: Sequence[str] = AS_LATEST) -> DataFrame:
    """A1 over a table and a batch that has arrived since: rows of the table come before all rows of the batch."""
    rows = batch.withColumn("__age", F.lit(1))
    if current is not None:
        rows = rows.unionByName(current.withColumns({"__age": F.lit(0), time_col: F.col("last_seen_at")}), allowMissingColumns=True)
    return upsert_products(rows, ("__age", *order), time_col, key_col, as_latest)


def upsert_offers(observations: DataFrame, order: Sequence[str], time_col: str = "observed_at") -> tuple[DataFrame, DataFrame]:
    """A2: ``(offers, conflicts)``. The first canonical id of a (source, source_product_id) holds; rows that would link it
    to another one are conflicts and change nothing.

    Rows without canonical id, product id or URL are no offers. Current offers take part as earlier observations. Rows are
    dealt by source and product id once: their owner is the first row's in a window, and as it is one, so is the offer.
    """
    rank = F.struct(*order)
    pair = ["source", "source_product_id"]
    whole = observations.where(F.col("canonical_product_id").isNotNull() & F.col("source_product_id").isNotNull() & F.col("source_url").isNotNull())
    in_order = Window.partitionBy(*pair).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = whole.withColumn("__owner", F.first("canonical_product_id").over(in_order))
    conflicts = owned.where(F.col("canonical_product_id") != F.col("__owner")).drop("__owner")
    kept = owned.where(F.col("canonical_product_id") == F.col("__owner")).drop("__owner")
    offers = upsert_products(kept, order, time_col, pair)
    return offers.select(F.concat_ws(":", "canonical_product_id", *pair).alias("offer_id"), *offers.columns), conflicts


def upsert_query_ranks(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """A3: ``(query_key, product_key, rank)``: a product's last rank for a query."""
    return hits.groupBy("query_key", "product_key").agg(F.max_by("rank", F.struct(*order)).alias("rank"))


#: A4: how the columns of equal records of one collection are merged.
FIRST_KNOWN = ("canonical_product_id", "product_name_ko", "product_name_en", "product_name_display_ko", "product_name_display_en", "shade", "source_url", "source_product_id")
LATEST_KNOWN = (
    "category", "source_brand_name", "source_brand_name_en", "original_price", "sale_price", "discount_rate", "currency", "image_url", "rating", "review_count",
    "description", "options", "sold_out", "updated_at",
)


def merge_records(records: DataFrame, order: Sequence[str], key_col: str = "record_key", text_empty_is_null: bool = True, keys_repeat: bool = True) -> DataFrame:
    """A4: one row for each key of a collection, in the order of first occurrence (``position`` holds its order tuple).

    Names, shade, URL and ids stay the first known; category, brands, prices, images and the like are the latest known;
    source and search keywords are the first row's. The regular price is the latest one that comes with an original or
    sale price, or else the first known one, which takes part as well. Where nearly every key comes once, ``keys_repeat=False``
    deals rows by their key as they are, which gives the same with less to shuffle.
    """
    rank = F.struct(*order)
    columns = set(records.columns)
    if text_empty_is_null:
        texts = [n for n, kind in records.dtypes if kind == "string" and n not in (key_col, "source") and n not in order]
        records = records.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in texts})
    folded = [_first_known(c, rank) for c in FIRST_KNOWN if c in columns and c not in order]
    folded += [_latest_known(c, rank) for c in LATEST_KNOWN if c in columns and c not in order]
    if "regular_price" in columns:
        regular, priced = F.col("regular_price"), F.lit(False)
        for c in ("original_price", "sale_price"):
            if c in columns:
                priced = priced | F.col(c).isNotNull()
        first = F.min_by(regular, F.when(regular.isNotNull(), rank))
        later = F.max_by(regular, F.when(regular.isNotNull() & priced, rank))
        at_first, at_later = F.min(F.when(regular.isNotNull(), rank)), F.max(F.when(regular.isNotNull() & priced, rank))
        folded.append(F.when(at_later > at_first, later).otherwise(first).alias("regular_price"))
    kept = [c for c in ("source", "search_keywords") if c in columns]
    folded += [F.min_by(F.struct(*kept), rank).alias("__first"), F.min(rank).alias("position")]
    merged = (records if keys_repeat else records.repartition(key_col)).groupBy(key_col).agg(*folded)
    return merged.select("*", *(F.col(f"__first.{c}").alias(c) for c in kept)).drop("__first")
