"""One product from many sources: offer merge, ordered product fold, backfill from offers, scores and missing fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.keys import DEFAULT_PRIORITY, offer_key
from quillmart.functions.text import let, service_key

#: An offer's fields that count for its completeness, and the fields a product takes over where it has none.
COMPLETENESS_FIELDS = ("source_url", "source_product_id", "price", "original_price", "sale_price", "image_url", "updated_at")
FILLED_FIELDS = (
    "brand_ko", "brand_en", "canonical_product_id", "product_name_ko", "product_name_en", "product_name_display_ko", "product_name_display_en", "shade",
    "category", "rating", "review_count", "description", "options", "sold_out", "updated_at",
)


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def quality_score(c: dict[str, Column]) -> Column:
    """0 to 110 points for what a product has. ``c`` maps field names to columns."""

    def given(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (F.coalesce(c[n].cast("string"), F.lit("")) != "")
        return out

    def known(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | c[n].isNotNull()
        return out

    parts = [
        (given("product_name_ko", "product_name_en"), 30), (given("source"), 20), (given("source_url", "source_product_id"), 20), (given("brand_ko"), 10),
        (given("brand_en"), 8), (given("product_name_en"), 8), (known("price"), 5), (given("image_url"), 5), (known("rating", "review_count"), 4),
    ]
    return _sum([F.when(test, points).otherwise(0) for test, points in parts])


def missing_fields(c: dict[str, Column]) -> Column:
    """Which of the four fields that enrichment fills are missing."""
    empty = lambda n: F.coalesce(c[n], F.lit("")) == ""
    flags = [F.when(empty(n), n) for n in ("brand_en", "product_name_en")] + [F.when(c["price"].isNull(), "price"), F.when(empty("image_url"), "image_url")]
    return F.array_compact(F.array(*flags))


def source_coverage_missing(c: dict[str, Column], offers: Column) -> Column:
    """Missing fields, and which of three kinds of source neither the product nor an offer comes from."""

    def none_of(prefix: str) -> Column:
        is_it = lambda s: (s == prefix) | s.startswith(prefix + ":")
        return ~(F.coalesce(is_it(c["source"]), F.lit(False)) | F.exists(offers, lambda o: is_it(o["source"])))

    names = {"musinsa": "musinsa_source", "oliveyoung-global": "oliveyoung_global_source", "official": "official_source"}
    return F.concat(missing_fields(c), F.array_compact(F.array(*(F.when(none_of(p), n) for p, n in names.items()))))


def offer_completeness(o: Column) -> Column:
    return _sum([F.when(o[f].isNotNull(), 1).otherwise(0) for f in COMPLETENESS_FIELDS])


def merge_offer_rows(offers: DataFrame, product: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A6 over a table: per product and offer key the best offer: reviewed ones first, then more complete, then earlier.

    Offers without URL are left out. The window's partial top row is taken before the shuffle.
    """
    rows = offers.where(F.coalesce("source_url", F.lit("")) != "").withColumn("offer_key", offer_key(F.col("source"), F.col("source_product_id"), F.col("source_url")))
    complete = _sum([F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in COMPLETENESS_FIELDS])
    reviewed = F.when(F.col("review_state").isNull(), 0).otherwise(1)
    best = Window.partitionBy(*product, "offer_key").orderBy(reviewed.desc(), complete.desc(), *order)
    return rows.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") == 1).drop("__rn")


def sorted_offers(offers: Column, fields: Sequence[str]) -> Column:
    """Offers by priority, source and URL."""
    head = F.transform(offers, lambda o: F.struct(F.coalesce(o["source_priority"], F.lit(DEFAULT_PRIORITY)).alias("p"), o["source"].alias("s"), o["source_url"].alias("u"), F.struct(*(o[f].alias(f) for f in fields)).alias("o")))
    return F.transform(F.array_sort(head), lambda x: x["o"])


def merge_offers(offers: Column, fields: Sequence[str]) -> Column:
    """A6 over an array of offers in order: one for each offer key, sorted by priority, source and URL."""
    ranked = F.transform(
        F.filter(offers, lambda o: F.coalesce(o["source_url"], F.lit("")) != ""),
        lambda o, i: F.struct(
            offer_key(o["source"], o["source_product_id"], o["source_url"]).alias("key"),
            F.when(o["review_state"].isNull(), 0).otherwise(1).alias("reviewed"),
            offer_completeness(o).alias("complete"),
            (-i).alias("earlier"),
            F.struct(*(o[f].alias(f) for f in fields)).alias("offer"),
        ),
    )

    def best(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
        return F.transform(keys, lambda k: F.array_max(F.filter(rows, lambda r: r["key"] == k))["offer"])

    return sorted_offers(let(ranked, best), fields)


def first_priced(offers: Column) -> Column:
    """The first offer with any price."""
    return F.try_element_at(F.filter(offers, lambda o: o["price"].isNotNull() | o["original_price"].isNotNull() | o["sale_price"].isNotNull()), F.lit(1))


def first_imaged(offers: Column) -> Column:
    return F.try_element_at(F.filter(offers, lambda o: F.coalesce(o["image_url"], F.lit("")) != ""), F.lit(1))


#: Price columns that an offer can fill, and those that come from it as well.
PRICES = ("price", "original_price", "sale_price")


def backfilled(c: dict[str, Column], offers: Column) -> dict[str, Column]:
    """The price columns and the image of ``c``, filled from the first priced and the first imaged offer where they are
    null; where a price is filled, the offer's currency holds, if it has one. Columns that ``c`` lacks are left out."""
    priced, imaged = first_priced(offers), first_imaged(offers)
    out = {n: F.coalesce(c[n], priced[n]) for n in PRICES if n in c}
    if "currency" in c:
        filled = F.lit(False)
        for n in PRICES:
            if n in c:
                filled = filled | (c[n].isNull() & priced[n].isNotNull())
        out["currency"] = F.when(filled, F.coalesce(F.nullif(priced["currency"], F.lit("")), c["currency"])).otherwise(c["currency"])
    if "image_url" in c:
        out["image_url"] = F.coalesce(c["image_url"], imaged["image_url"])
    return out


def merge_products(products: DataFrame, key_col: str, order: Sequence[str], fields: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """A5: products of one merge key become one, in order.

    Going through the rows in order, the representative is replaced by a row of better source priority, or of the same
    priority and a quality above the *greatest* quality so far; the other one's values fill its empty fields. Search
    keywords, if they are among the fields, are those of all rows, each service key once. Rows with a null key are never
    merged. ``group`` keeps searches apart. Returns ``group, key, fields, quality_score,
    source_priority, source, n_merged, position``.

    What a fold of the rows in order would give is told by two running values, the best priority and the greatest quality
    before a row: they say which rows replace the representative. A field is that of the last such row that has it; a
    filled field that none of them has is the first known one. So the rows of a key stream through a window and an
    aggregation in one pass, dealt and sorted once, and a key may have any number of them. (Keywords are gathered, each
    list once.) Rows without a key are given as they are, without a shuffle; ``products`` is read once for each kind, so
    keys that are long to make should be made before.
    """
    held = list(dict.fromkeys([*fields, "source", "source_priority", "quality_score"]))
    rank = F.struct(*order)
    keyed = products.withColumn("__key", F.col(key_col)).where(F.col("__key").isNotNull())
    rows = keyed.withColumns({"__at": rank, "__p": F.coalesce("source_priority", F.lit(DEFAULT_PRIORITY)), "__hash": F.xxhash64("__key")})
    # Keys often begin alike; by their hash first, rows are sorted without comparing them.
    together = (*group, "__hash", "__key")
    earlier = Window.partitionBy(*together).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__best": F.min("__p").over(earlier), "__most": F.max("quality_score").over(earlier), "__no": F.count(F.lit(1)).over(earlier)})
    better = (F.col("__no") == 0) | (F.col("__p") < F.col("__best")) | ((F.col("__p") == F.col("__best")) & (F.col("quality_score") > F.col("__most")))
    rows = rows.withColumn("__better", F.coalesce(better, F.lit(False)))

    def united(lists: Column) -> Column:
        union = F.reduce(lists, F.array().cast("array<string>"), lambda acc, x: text_union(acc, x))
        return let(union, lambda u: F.when(F.size(u) > 0, u))

    def folded(f: str) -> Column:
        if f == "quality_score":
            return F.max(f)
        if f == "search_keywords":
            lists = F.sort_array(F.collect_list(F.when(F.col(f).isNotNull(), F.struct("__at", f))))
            return united(F.transform(lists, lambda x: x[f]))
        if f in FILLED_FIELDS:
            known = F.col(f).isNotNull()
            return F.coalesce(F.max_by(f, F.when(F.col("__better") & known, F.col("__at"))), F.min_by(f, F.when(known, F.col("__at"))))
        return F.max_by(f, F.when(F.col("__better"), F.col("__at")))

    merged = rows.groupBy(*together).agg(*(folded(f).alias(f) for f in held), F.count(F.lit(1)).cast("int").alias("n_merged"), F.min("__at").alias("position"))
    merged = merged.select(*group, F.col("__key").alias("key"), *held, "n_merged", "position")
    own = (united(F.array(F.coalesce(f, F.array().cast("array<string>")))).alias(f) if f == "search_keywords" else F.col(f) for f in held)
    alone = products.where(F.col(key_col).isNull()).select(*group, F.col(key_col).alias("key"), *own, F.lit(1).alias("n_merged"), rank.alias("position"))
    return merged.unionByName(alone)


def attach_offers(results: DataFrame, offers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Results with the stored offers of their canonical product merged in, and ``pending_offers`` held back.

    ``results`` has ``canonical_product_id`` and ``offers``; stored ``offers`` have the same fields. Only offers without
    review or verified ones are shown, and prices and image of the result are filled from them (:func:`backfilled`), where
    the result has such columns and offers such fields.
    """
    stored = offers.groupBy("canonical_product_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__stored"))
    joined = results.join(stored, "canonical_product_id", "left")
    empty = F.col("offers").isNull()
    every = F.concat(F.when(empty, F.array().cast(results.schema["offers"].dataType)).otherwise(F.col("offers")), F.coalesce("__stored", F.array().cast(results.schema["offers"].dataType)))
    merged = joined.withColumn("offers", merge_offers(every, fields))
    pending = F.size(F.filter("offers", lambda o: o["review_state"] == "pending_review"))
    shown = F.filter("offers", lambda o: o["review_state"].isNull() | (o["review_state"] == "verified"))
    shown = merged.withColumns({"pending_offers": pending, "offers": shown}).drop("__stored")
    known = {n: F.col(n) for n in (*PRICES, "currency", "image_url") if n in results.columns and n in fields}
    return shown.withColumns(backfilled(known, F.col("offers"))) if known else shown


def text_union(left: Column, right: Column) -> Column:
    """Keywords of two lists, trimmed, each service key once."""
    both = F.concat(F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>")))
    pairs = F.filter(F.transform(both, lambda t: F.struct(service_key(t).alias("key"), F.trim(t).alias("text"))), lambda p: p["text"] != "")
    return let(pairs, lambda p: F.transform(F.array_distinct(p["key"]), lambda k: F.element_at(p["text"], F.array_position(p["key"], k).cast("int"))))
