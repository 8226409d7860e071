"""Results of searches: filters, tabs, responses, sufficiency; and the sets of queries that are run for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmart.functions.keys import source_allowed
from quillmart.functions.text import casefold, clean_text, search_key, service_key
from quillmart.operators.containment import join_inside
from quillmart.operators.merge import attach_offers
from quillmart.operators.upsert import merge_records


def brand_filter(needle: str, official: str | None = None) -> Column:
    """Whether a product's brands or name hold a brand, as text or by key."""
    names = [F.coalesce("brand_en", F.lit("")), F.coalesce("brand_ko", F.lit("")), F.coalesce(F.nullif("product_name_ko", F.lit("")), F.col("product_name_en"), F.lit(""))]
    out = F.lit(False)
    for text, fields in ((needle, names), (official, names[:2])):
        if text:
            plain, key = casefold(F.lit(text)), service_key(F.lit(text))
            for f in fields:
                out = out | F.contains(casefold(f), plain) | ((key != "") & F.contains(service_key(f), key))
    return out


def apply_filters(products: DataFrame, brand: str | None = None, official: str | None = None, min_price: float | None = None, max_price: float | None = None, has_shade: bool | None = None) -> DataFrame:
    """Products that meet all filters given. Price bounds hold for prices in KRW only."""
    if brand:
        products = products.where(brand_filter(brand, official))
    krw = F.coalesce("currency", F.lit("KRW")) == "KRW"
    if min_price is not None:
        products = products.where(krw & (F.col("price") >= min_price))
    if max_price is not None:
        products = products.where(krw & (F.col("price") <= max_price))
    if has_shade is not None:
        products = products.where((F.coalesce("shade", F.lit("")) != "") == F.lit(has_shade))
    return products


def core_complete(products: DataFrame) -> DataFrame:
    """Products with a name, a source, and a URL or id."""
    given = lambda n: F.coalesce(n, F.lit("")) != ""
    return products.where((given("product_name_ko") | given("product_name_en")) & given("source") & (given("source_url") | given("source_product_id")))


def only_allowed(products: DataFrame, prefixes: list[str]) -> DataFrame:
    """Products of allowed sources with their offers of allowed sources."""
    kept = products.where(source_allowed(F.col("source"), prefixes))
    return kept.withColumn("offers", F.filter("offers", lambda o: source_allowed(o["source"], prefixes))) if "offers" in kept.columns else kept


def tab_counts(products: DataFrame, tabs: Sequence[str]) -> DataFrame:
    """``(tab, n)``: products by source prefix, and all of them."""
    counts = products.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.startswith("source", F.lit(t))).alias(t) for t in tabs))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tab"), F.col(f"`{t}`").alias("n")) for t in ("all", *tabs)))).alias("t")).select("t.*")


def responses(queries: DataFrame, results: DataFrame, limit: int, live: bool = False, gaps_recorded: bool = True) -> DataFrame:
    """Per query the number of results, completeness, and the latest update among them."""
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"), F.max("updated_at").alias("checked_at"))
    joined = queries.select("query_id").join(found, "query_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    nothing = "unavailable" if live or not gaps_recorded else "empty_pending"
    state = F.when(F.col("count") == 0, nothing).when((F.col("count") >= limit) | F.lit(live), "complete").otherwise("partial")
    return joined.withColumn("completeness", state)


def assemble_responses(
    queries: DataFrame, results: DataFrame, offers: DataFrame, limit: int, offer_fields: Sequence[str], origin: str = "index_cache", live: bool = False, gaps_recorded: bool = True
) -> DataFrame:
    """R16 in full: ``query_id, count, results, completeness, freshness, pending_offer_count`` of every query.

    ``results`` has ``query_id, rank, canonical_product_id, offers, updated_at`` and what else a result shows; stored
    ``offers`` have ``canonical_product_id`` and ``offer_fields``. Offers under review are held back and counted. ``results``
    is an array of structs by rank, empty without any; ``freshness`` is a struct ``(origin, checked_at)``, the latest
    update among them, null without results. A query's results are as many as its page.
    """
    shown = attach_offers(results, offers, offer_fields)
    kept = [c for c in results.columns if c not in ("query_id", "rank")]
    page = F.sort_array(F.collect_list(F.struct("rank", F.struct(*kept).alias("r"))))
    held = shown.groupBy("query_id").agg(F.transform(page, lambda x: x["r"]).alias("results"), F.max(F.nullif(F.col("updated_at").cast("string"), F.lit(""))).alias("__at"), F.sum("pending_offers").alias("__pending"))
    told = responses(queries, results, limit, live, gaps_recorded).drop("checked_at").join(held, "query_id", "left")
    some = F.col("count") > 0
    return told.select(
        "query_id", "count", F.coalesce("results", F.array().cast(told.schema["results"].dataType)).alias("results"), "completeness",
        F.when(some, F.struct(F.lit(origin).alias("origin"), F.col("__at").alias("checked_at"))).alias("freshness"), F.coalesce("__pending", F.lit(0)).alias("pending_offer_count"),
    )


def union_sources(records: DataFrame, limit: int, order: Sequence[str], key_col: str = "record_key", query_col: str = "query_id") -> DataFrame:
    """The records of all sources that a query has collected, merged by their collection key (K8, A4), at most
    ``2 * limit`` of each query.

    ``records`` has ``query_id``, ``record_key``, ``source_class`` (0: the primary retailer for the primary query, 1: the
    primary retailer for expansions, 2: other sources) and ``order``, the order in which a class has come. Classes come in
    turn; a record stands where its first observation stands. Adds ``no``, from 1.
    """
    keyed = records.withColumn("__union", F.struct(F.col(query_col).alias("q"), F.col(key_col).alias("k"))).drop(query_col, key_col)
    merged = merge_records(keyed, ("source_class", *order), "__union")
    place = Window.partitionBy("__union.q").orderBy("position", "__union.k")
    rows = merged.withColumn("no", F.row_number().over(place)).where(F.col("no") <= 2 * max(limit, 1))
    return rows.select(F.col("__union.q").alias(query_col), F.col("__union.k").alias(key_col), "no", *(c for c in merged.columns if c not in ("__union", "position")))


def is_sufficient(count: Column, limit: int, brand_only: Column, broad: Column) -> Column:
    """Whether the index has answered a query: any result, but up to eight for broad ones that name no brand alone."""
    threshold = 0 if limit <= 1 else min(limit, 8)
    return F.when(count >= limit, True).when(brand_only | ~broad, count > 0).otherwise(count >= threshold)


def dedupe_queries(queries: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cleaned queries with their key, the first of each key."""
    keyed = queries.select(clean_text(F.col("query")).alias("query"), search_key(F.col("query")).alias("query_key"), F.struct(*order).alias("at")).where(F.col("query_key") != "")
    return keyed.groupBy("query_key").agg(F.min_by("query", "at").alias("query"), F.min("at").alias("at"))


def plan_queries(parts: Sequence[DataFrame], limit: int | None = None) -> DataFrame:
    """``(position, query)`` of the parts' queries in the order of the parts, each key once, the first ``limit``.

    Each part has ``query, position``, the position a number or a text to be ordered by. Positions are numbered after the
    limit; without one they are the parts' own.
    """
    rows = None
    for no, part in enumerate(parts):
        by_text = isinstance(part.schema["position"].dataType, StringType)
        at = F.struct((F.lit(0) if by_text else F.col("position")).cast("long").alias("number"), (F.col("position") if by_text else F.lit("")).alias("text"))
        one = part.select("query", F.lit(no).alias("part"), at.alias("position"))
        rows = one if rows is None else rows.unionByName(one)
    once = dedupe_queries(rows, ("part", "position"))
    if limit is None:
        return once.select("at", "query_key", "query")
    return once.orderBy("at").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("at"))).select("rank", "query_key", "query")


def coverage_pairs(brands: DataFrame, categories: DataFrame, limit: int) -> DataFrame:
    """``(query, position)``: brand and category pairs in order, at most ``limit``.

    The first ``limit`` pairs need no more than the first ``limit`` brands and categories, so the product is that of two
    bounded lists, made by exploding one as an array; positions (numbers or texts) are numbered within these.
    """
    few = [df.select(clean_text(F.col("query")).alias("q"), "position").where(F.col("q").isNotNull()).orderBy("position").limit(limit) for df in (brands, categories)]
    listed = few[1].agg(F.sort_array(F.collect_list(F.struct("position", "q"))).alias("c")).first()["c"]
    names = F.array(*(F.lit(x["q"]) for x in listed)) if listed else F.array().cast("array<string>")
    numbered = few[0].withColumn("position", F.row_number().over(Window.orderBy("position", "q")))  # of ``limit`` rows
    pairs = numbered.select("q", "position", F.posexplode(names).alias("no", "category"))
    at = F.col("position").cast("long") * max(len(listed), 1) + F.col("no")
    keyed = pairs.select(F.concat_ws(" ", "q", "category").alias("query"), at.alias("position"))
    return dedupe_queries(keyed, ("position",)).orderBy("at").limit(limit).select("query", F.col("at.position").alias("position"))


def rescue_queries(expanded: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """Expanded queries whose key hasn't been run, in order, at most ``limit`` for each query."""
    ran = done.select("query_id", search_key(F.col("query")).alias("key")).distinct()
    left = expanded.withColumn("key", search_key(F.col("query"))).where(F.col("key") != "").join(ran, ["query_id", "key"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("candidate")
    return left.withColumn("no", F.row_number().over(order)).where(F.col("no") <= limit)


def expand_terms(queries: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """``(query_id, no, term)`` of entries whose key is in the query's key or holds it, without the query itself.

    ``entries`` has ``entry, terms array, position``. Keys meet by equi-joins on the substrings of the longer one.
    """
    own = queries.select("query_id", search_key(F.col("query")).alias("qkey")).where(F.col("qkey") != "")
    keyed = entries.select(search_key(F.col("entry")).alias("ekey"), "terms", "position").where(F.col("ekey") != "")
    asked, known = own.select("qkey").distinct(), keyed.select("ekey").distinct()
    pairs = join_inside(asked, "qkey", known, "ekey").unionByName(join_inside(known, "ekey", asked, "qkey").select("qkey", "ekey")).distinct()
    met = own.join(pairs, "qkey").join(keyed, "ekey")
    rows = met.select("query_id", "qkey", "position", F.posexplode("terms").alias("at", "term")).withColumn("tkey", search_key(F.col("term")))
    once = rows.where((F.col("tkey") != "") & (F.col("tkey") != F.col("qkey"))).groupBy("query_id", "tkey").agg(F.min_by("term", F.struct("position", "at")).alias("term"), F.min(F.struct("position", "at")).alias("place"))
    order = Window.partitionBy("query_id").orderBy("place", "tkey")
    return once.withColumn("no", F.row_number().over(order)).where(F.col("no") <= limit).select("query_id", "no", "term")


def exact_expansions(queries: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """``(query_id, no, term)``: the related queries that a table ``(entry, terms)`` lists under a query's very key."""
    keyed = table.select(search_key(F.col("entry")).alias("key"), "terms").where(F.col("key") != "")
    met = queries.select("query_id", search_key(F.col("query")).alias("key")).join(keyed, "key").select("query_id", F.posexplode("terms").alias("no", "term"))
    return met.where(F.col("no") < limit).select("query_id", (F.col("no") + 1).alias("no"), "term")
