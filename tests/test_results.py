"""Unions of sources, responses with stored offers, keyword unions, and normalizing stored records again, by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillmart.operators import analytics, merge, normalize, results

OFFER = "source string, source_product_id string, source_url string, price double, original_price double, sale_price double, currency string, image_url string, updated_at string, review_state string, source_priority int"
FIELDS = [f.split()[0] for f in OFFER.split(", ")]


def offer(source, number, price=None, state=None, image=None, priority=10, currency="USD"):
    return (source, number, f"https://x/{number}", price, None, None, currency, image, "2024", state, priority)


def test_records_of_sources_come_in_turn(spark):
    rows = [
        ("q", 2, 1, "x:1", "x", "late"), ("q", 0, 5, "o:1", "o", None), ("q", 1, 1, "o:2", "o", "e"), ("q", 0, 2, "o:2", "o", None), ("q", 2, 9, "o:1", "x", "filled"), ("q", 2, 0, "y:1", "y", "cut"),
        ("r", 2, 0, "y:1", "y", "other query"), (None, 0, 0, "z:1", "z", "no query"),
    ]
    df = spark.createDataFrame(rows, "query_id string, source_class int, pos int, record_key string, source string, category string").repartition(3)
    got = [tuple(r) for r in results.union_sources(df, 2, ("pos",)).select("query_id", "record_key", "no", "source", "category").orderBy("query_id", "no").collect()]
    assert got == [
        (None, "z:1", 1, "z", "no query"), ("q", "o:2", 1, "o", "e"), ("q", "o:1", 2, "o", "filled"), ("q", "y:1", 3, "y", "cut"), ("q", "x:1", 4, "x", "late"), ("r", "y:1", 1, "y", "other query"),
    ]
    assert [r["no"] for r in results.union_sources(df, 1, ("pos",)).where("query_id = 'q'").collect()] == [1, 2]
    assert results.union_sources(df.limit(0), 1, ("pos",)).collect() == []


def test_responses_hide_and_count_offers_under_review(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    own = [offer("s", "1", 5.0)]
    found = spark.createDataFrame(
        [("a", 2, "c2", None, None, 9.0, "KRW", "img"), ("a", 1, "c1", own, "2025", None, "KRW", None), ("b", 1, None, None, "", None, None, None)],
        f"query_id string, rank int, canonical_product_id string, offers array<struct<{OFFER.replace(' ', ':').replace(',:', ',')}>>, updated_at string, price double, currency string, image_url string",
    )
    stored = [("c1", *offer("t", "2", 7.0, "pending_review")), ("c1", *offer("t", "3", None, None, "pic", 1)), ("c1", *offer("t", "4", 1.0, "rejected")), ("c2", *offer("t", "5", 3.0, "verified"))]
    offers = spark.createDataFrame(stored, f"canonical_product_id string, {OFFER}")
    got = {r["query_id"]: r for r in results.assemble_responses(queries, found, offers, 2, FIELDS).collect()}
    a = got["a"]
    assert (a["count"], a["completeness"], a["freshness"]["checked_at"], a["freshness"]["origin"], a["pending_offer_count"]) == (2, "complete", "2025", "index_cache", 1)
    first, second = a["results"]
    assert [o["source_product_id"] for o in first["offers"]] == ["3", "1"] and (first["price"], first["currency"], first["image_url"]) == (5.0, "USD", "pic")
    assert [o["source_product_id"] for o in second["offers"]] == ["5"] and (second["price"], second["currency"], second["image_url"]) == (9.0, "KRW", "img")
    assert (got["b"]["count"], got["b"]["completeness"], got["b"]["freshness"]["checked_at"], len(got["b"]["results"])) == (1, "partial", None, 1)
    assert (got["c"]["count"], got["c"]["completeness"], got["c"]["freshness"], got["c"]["results"], got["c"]["pending_offer_count"]) == (0, "empty_pending", None, [], 0)


def test_merged_products_have_all_keywords(spark):
    schema = "key string, pos int, source string, source_priority int, quality_score int, brand_en string, search_keywords array<string>"
    rows = [("k", 1, "A", 30, 1, None, [" Lip ", ""]), ("k", 2, "B", 10, 1, "b", None), ("k", 3, "C", 20, 1, "c", ["lip", "Tint"]), ("l", 1, "A", 1, 1, None, None), ("l", 2, "A", 1, 1, None, [" "])]
    got = {r["key"]: r for r in merge.merge_products(spark.createDataFrame(rows, schema), "key", ("pos",), ["brand_en", "search_keywords"]).collect()}
    assert (got["k"]["source"], got["k"]["search_keywords"], got["l"]["search_keywords"]) == ("B", ["Lip", "Tint"], None)


def test_failed_queries_have_rows(spark):
    asked = spark.createDataFrame([("g", "1"), ("g", "2"), ("g", "3"), ("h", "4"), (None, "5")], "group string, query_id string")
    found = spark.createDataFrame([("2",), ("2",), ("4",)], "query_id string")
    assert sorted(map(tuple, analytics.failed_queries(asked, found).collect()), key=str) == [("g", "1"), ("g", "3"), (None, "5")]
    assert {r["group"]: (r["total"], r["passed"]) for r in analytics.coverage_backtest(asked, found).collect()} == {"g": (3, 1), "h": (1, 1), None: (1, 0)}


def test_plans_take_texts_or_numbers_as_positions(spark):
    brands = spark.createDataFrame([("b", "b"), ("a", "a"), (" ", "0")], "query string, position string")
    types = spark.createDataFrame([("y", 9), ("x", 4)], "query string, position int")
    pairs = results.coverage_pairs(brands, types, 3)
    assert [r["query"] for r in pairs.orderBy("position").collect()] == ["a x", "a y", "b x"]
    assert [r["query"] for r in results.plan_queries([brands, pairs, types], 6).orderBy("rank").collect()] == ["a", "b", "a x", "a y", "b x", "x"]


@pytest.mark.parametrize("recompute", [True, False])
def test_stored_records_are_normalized_again(spark, recompute):
    none = {c: F.lit(None).cast("string") for c in ("canonical_product_id", "product_name_en", "product_name_display_en", "category", "shade", "image_url", "description", "updated_at", "source_brand_name_en")}
    none |= {c: F.lit(None).cast("double") for c in ("regular_price", "original_price", "sale_price", "rating")} | {"review_count": F.lit(None).cast("int"), "sold_out": F.lit(None).cast("boolean")}
    rows = [(1, "a:x", "클리오", "[특가] 클리오 쿠션 15g", "old", "/1", "KRW", "old"), (2, "b", "클리오", "클리오 쿠션", None, None, None, "old"), (3, "a", "Clio", None, None, "https://s/3", "KRW", "old"), (4, "a", None, "NEW 쿠션", "x", None, "KRW", None)]
    df = spark.createDataFrame(rows, "source_product_id int, source string, source_brand_name string, product_name_ko string, product_name_display_ko string, source_url string, currency string, search_text string").withColumns(none)
    df = df.withColumn("source_product_id", F.col("source_product_id").cast("string"))
    aliases = normalize.alias_table(spark.createDataFrame([("CLIO", "클리오", 0), ("CLIO", "Clio", 1)], "official_en string, alias string, position int"))
    updated, changes, summary, sampled = normalize.renormalize_backfill(df, aliases, "https://s", "source_product_id", recompute, ("a",), samples=2)
    told = {(r["source_product_id"], r["field"]): (r["before"], r["after"]) for r in changes.collect()}
    want = {("1", "source_brand_name_en"): (None, "CLIO"), ("1", "source_url"): ("/1", "https://s/1"), ("3", "source_brand_name_en"): (None, "CLIO")}
    shown = {("1", "product_name_display_ko"): ("old", "쿠션"), ("1", "product_name_display_en"): (None, "Cushion Foundation"), ("4", "product_name_display_ko"): ("x", "쿠션"), ("4", "product_name_display_en"): (None, "Cushion Foundation")}
    assert told == want | (shown if recompute else {})
    counts = {r["measure"]: r["n"] for r in summary.collect()}
    assert counts["scanned"] == 3 and counts["changed"] == (3 if recompute else 2) and counts["field:source_brand_name_en"] == 2 and "field:currency" not in counts
    assert [r["source_product_id"] for r in sampled.collect()] == (["1", "3"])
    after = {r["source_product_id"]: r for r in updated.collect()}
    assert len(after) == 4 and set(updated.columns) == set(df.columns)
    assert after["2"]["currency"] is None and after["2"]["search_text"] == "old" and after["1"]["search_text"] not in ("old", None)
    assert after["3"]["source_brand_name"] is None  # a changed record has all columns as normalized; a Latin brand is no Korean one
    assert after["4"]["product_name_display_ko"] == ("쿠션" if recompute else "x")


def fold_by_hand(rows):
    """The fold, row by row: ``rows`` are (priority, quality, name, category, keywords) in order."""
    acc = None
    for p, q, name, category, words in rows:
        p = merge.DEFAULT_PRIORITY if p is None else p
        words = [w.strip() for w in words or [] if w.strip()]
        if acc is None:
            acc = {"p": p, "q": q, "source": name, "brand_en": category, "words": list(dict.fromkeys(words))}
            continue
        better = p < acc["p"] or (p == acc["p"] and q is not None and acc["q"] is not None and q > acc["q"])
        acc["brand_en"] = (category if category is not None else acc["brand_en"]) if better else (acc["brand_en"] if acc["brand_en"] is not None else category)
        if better:
            acc["p"], acc["source"] = p, name
        acc["q"] = max((x for x in (acc["q"], q) if x is not None), default=None)
        acc["words"] = list(dict.fromkeys(acc["words"] + words))
    return acc["source"], acc["q"], acc["brand_en"], acc["words"] or None, len(rows)


def test_the_product_fold_is_that_of_rows_in_turn(spark):
    rng = random.Random(4)
    keys = {f"k{i}": [(rng.choice([10, 20, 30, None]), rng.choice([1, 2, 3, 5, 8]), f"s{i}.{j}", rng.choice([None, None, "a", "b", "c"]), rng.choice([None, ["x"], [" y ", "", "z"]])) for j in range(rng.randint(1, 9))] for i in range(150)}
    rows = [(k, j, n, p, q, c, w) for k, rs in keys.items() for j, (p, q, n, c, w) in enumerate(rs)] + [(None, 0, "alone", 1, 1, "a", ["x"])] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, pos int, source string, source_priority int, quality_score int, brand_en string, search_keywords array<string>").repartition(3)
    got = merge.merge_products(df, "key", ("pos",), ["brand_en", "search_keywords"]).collect()
    assert sum(r["key"] is None for r in got) == 2
    assert {r["key"]: (r["source"], r["quality_score"], r["brand_en"], r["search_keywords"], r["n_merged"]) for r in got if r["key"]} == {k: fold_by_hand(rs) for k, rs in keys.items()}
    assert merge.merge_products(df.limit(0), "key", ("pos",), ["brand_en"]).collect() == []
