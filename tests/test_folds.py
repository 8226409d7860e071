"""Folds give the same rows whatever the order of their input; small golden cases of each rule."""

import random

from pyspark.sql import functions as F

from quillmart.operators import analytics, jobs, matches, merge, search, upsert

OBS = "record_key string, seq int, observed_at int, source string, canonical_product_id string, source_product_id string, source_url string, category string, regular_price double, original_price double, sale_price double"


def shuffled(spark, rows, schema, seed=0):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_products_keep_latest_known_values(spark):
    rows = [("k", 1, 1, "a", "c1", "p", "u", "x", None, 5.0, 4.0), ("k", 2, 2, "b", None, None, "u2", None, 9.0, None, None), ("z", 1, 7, "a", None, None, None, None, None, None, None)]
    for seed in range(3):
        got = {r["record_key"]: r for r in upsert.upsert_products(shuffled(spark, rows, OBS, seed), ("seq",)).collect()}
        k = got["k"]
        assert (k["canonical_product_id"], k["source_url"], k["category"], k["original_price"]) == ("c1", "u2", "x", 5.0)
        assert (k["source"], k["sale_price"], k["first_seen_at"], k["last_seen_at"]) == ("b", None, 1, 2)
        assert len(got) == 2


def test_first_link_of_an_offer_holds(spark):
    rows = [("k", i, i, "s", c, "p", "u", None, None, None, float(i)) for i, c in enumerate(["c1", "c2", "c1", "c3"])] + [("k", 9, 9, "s", None, "p", "u", None, None, None, None), ("k", 10, 10, "s", "c9", None, "u", None, None, None, None)]
    for seed in range(3):
        offers, conflicts = upsert.upsert_offers(shuffled(spark, rows, OBS, seed), ("seq",))
        (offer,) = offers.collect()
        assert (offer["canonical_product_id"], offer["sale_price"]) == ("c1", 2.0)
        assert sorted(r["canonical_product_id"] for r in conflicts.collect()) == ["c2", "c3"]


def test_merged_records_prefer_as_they_should(spark):
    rows = [("k", 1, 1, "a", None, "", "u1", "x", None, None, None), ("k", 2, 2, "b", "c", "p", "u2", "", 7.0, None, None), ("k", 3, 3, "c", "d", "q", "u3", "y", 8.0, None, None), ("k", 4, 4, "c", "d", "q", "u3", "y", 9.0, None, 1.0)]
    want = {1: None, 2: 7.0, 3: 7.0, 4: 9.0}
    for n in want:
        (r,) = upsert.merge_records(shuffled(spark, rows[:n], OBS, n), ("seq",)).collect()
        assert r["regular_price"] == want[n]
    assert (r["source"], r["canonical_product_id"], r["source_product_id"], r["source_url"], r["category"]) == ("a", "c", "p", "u1", "y")


def test_product_fold_compares_with_the_greatest_quality(spark):
    schema = "key string, pos int, source string, source_priority int, quality_score int, brand_en string"
    rows = [("k", 1, "A", 30, 90, None), ("k", 2, "B", 10, 40, "b"), ("k", 3, "C", 10, 50, "c"), (None, 4, "D", 1, 1, None), (None, 5, "D", 1, 1, None)]
    for seed in range(3):
        got = merge.merge_products(shuffled(spark, rows, schema, seed), "key", ("pos",), ["brand_en"]).collect()
        (k,) = [r for r in got if r["key"] == "k"]
        assert (k["source"], k["quality_score"], k["brand_en"], k["n_merged"]) == ("B", 90, "b", 3)
        assert len(got) == 3


OFFER = "source string, source_product_id string, source_url string, price double, original_price double, sale_price double, image_url string, updated_at string, review_state string, source_priority int"
FIELDS = [f.split(" ")[0] for f in OFFER.split(", ")]


def test_offer_merge_and_backfill(spark):
    offers = [("s", "1", "u", None, None, None, None, None, None, 20), ("s", "1", "u", 5.0, None, None, None, None, None, 20), ("s", "1", "v", None, None, None, None, None, "verified", 20), ("a", None, "w", None, 3.0, None, "i", None, None, 10), ("a", None, None, 1.0, None, None, None, None, None, 1)]
    df = spark.createDataFrame([("c", offers)], f"canonical_product_id string, offers array<struct<{', '.join(x.replace(' ', ':') for x in OFFER.split(', '))}>>")
    (r,) = df.select(merge.merge_offers(F.col("offers"), FIELDS).alias("o")).select("o", merge.first_priced(F.col("o")).alias("p"), merge.first_imaged(F.col("o")).alias("i")).collect()
    assert [(o["source"], o["source_url"]) for o in r["o"]] == [("a", "w"), ("s", "v")]
    assert r["p"]["original_price"] == 3.0 and r["i"]["image_url"] == "i"
    stored = spark.createDataFrame([("c", "t", "9", "x", 1.0, None, None, None, None, "pending_review", 5), ("c", "t", "8", "y", 1.0, None, None, None, None, "rejected", 5)], "canonical_product_id string, " + OFFER)
    (r,) = merge.attach_offers(df, stored, FIELDS).collect()
    assert r["pending_offers"] == 1 and [o["source"] for o in r["offers"]] == ["a", "s"]


def test_versioned_reviews(spark):
    ledger = spark.createDataFrame([("m", "pending_review", 0)], "match_id string, review_state string, updated_at int")
    log = [("m", 1, "verified", 10, 0), ("m", 2, "rejected", 20, 0), ("m", 3, "verified", 30, None), ("m", 4, "rejected", 40, 10), ("x", 1, "verified", 5, None)]
    for seed in range(3):
        got = matches.apply_versioned_reviews(ledger, shuffled(spark, log, "match_id string, seq int, decision string, decided_at int, expected_version int", seed), ("seq",)).collect()
        assert sorted((r["match_id"], r["seq"], r["outcome"], r["previous_state"]) for r in got) == [
            ("m", 1, "updated", "pending_review"), ("m", 2, "conflict", "verified"), ("m", 3, "noop", "verified"), ("m", 4, "updated", "verified"), ("x", 1, "not_found", None),
        ]


def test_import_outcomes(spark):
    rows = [("c1", "s", "1", "u", "title", "0.8"), ("c1", "s", "2", "u", "title", "0.8"), ("c1", "s", "3", "u", "title", "1.8"), ("c9", "s", "4", "u", "title", "0.8"), ("c1", "s", "5", "u", "title", "0.8"), ("c1", "s", "6", "u", "title", "0.8"), ("c1", "s", " ", "u", "title", "0.8")]
    got = matches.import_candidates(
        spark.createDataFrame(rows, "canonical_product_id string, source string, source_product_id string, source_url string, match_method string, confidence string"),
        spark.createDataFrame([("c1",), ("c2",)], "canonical_product_id string"),
        spark.createDataFrame([("c2", "s", "2"), ("c1", "s", "5")], "canonical_product_id string, source string, source_product_id string"),
        spark.createDataFrame([("match:c1:s:5", "pending_review"), ("match:c1:s:6", "verified")], "match_id string, review_state string"),
    ).collect()
    assert sorted((r["source_product_id"], r["outcome"], r["reason"]) for r in got) == [
        (" ", "invalid", "missing source_product_id"), ("1", "created", None), ("2", "conflict", None), ("3", "invalid", "confidence"), ("4", "unknown", None), ("5", "updated", None), ("6", "preserved", None),
    ]


def test_jobs_complete_and_gaps_ask(spark):
    table = spark.createDataFrame([(1, "running", None, None), (2, "running", "old", None), (3, "pending", None, None)], "id int, status string, last_error string, finished_at int")
    done = spark.createDataFrame([(1, "completed", 5, None, 10), (1, "failed", -2, "e", 11), (2, "odd", 1, None, 12)], "id int, new_status string, new_count int, new_error string, at int")
    got = {r["id"]: (r["status"], r["product_count"], r["last_error"], r["finished_at"]) for r in jobs.complete_jobs(table, done).collect()}
    assert got == {1: ("failed", 0, "e", 11), 2: ("failed", 1, None, 12), 3: ("pending", None, None, None)}
    log = spark.createDataFrame([(1, 1, "Lip Tint", 0), (2, 2, "립틴트", 3), (3, 3, "x", 8), (4, 4, " ", 0)], "seq int, ts int, query string, result_count int")
    (gap,) = analytics.fold_search_gaps(log, ("seq",)).collect()
    assert (gap["miss_count"], gap["query"], gap["last_reason"], gap["result_count"]) == (2, "립틴트", "low_result_count", 3)
    assert analytics.fold_search_gaps(log, ("seq",), limit=1).collect() == []
    asked = jobs.gap_requests(analytics.fold_search_gaps(log, ("seq",)))
    (new,) = jobs.enqueue_jobs(spark.createDataFrame([], "job_key string, kind string, query string, priority int, status string, attempt_count int, max_attempts int"), asked).collect()
    assert (new["job_key"], new["priority"], new["status"]) == ("search:립틴트", 20, "pending")


def test_search_by_alias_tier_and_suggestion(spark):
    aliases = spark.createDataFrame([("clio", "Clio", "CLIO"), ("클리오", "클리오", "CLIO"), ("hera", "Hera", "HERA")], "alias_key string, alias string, official_en string")
    got = search.expand_aliases(spark.createDataFrame([(1, "clio cushion"), (2, "q")], "query_id int, query string"), aliases).collect()
    assert sorted((r["query_id"], r["candidate"], r["query"]) for r in got) == [(1, 0, "clio cushion"), (1, 1, "클리오"), (1, 2, "Clio"), (2, 0, "q")]
    texts = spark.createDataFrame([("Lip balm", 0), ("Tinted lip", 1), ("LIP  balm", 2), ("nose", 3), ("Lipo", 4)], "text string, position int")
    got = search.rank_suggestions(spark.createDataFrame([(1, "lip"), (2, "no")], "prefix_id int, prefix string"), texts, 3).collect()
    assert sorted((r["prefix_id"], r["rank"], r["text"]) for r in got) == [(1, 1, "Lipo"), (1, 2, "Tinted lip"), (2, 1, "nose")]


def test_document_scores(spark):
    schema = "query string, expanded_terms array<string>, name string, name_en string, brand string, brand_en string, category string, description string, tags array<string>, ingredients array<string>, review_keywords array<string>, rating double, review_count int, sales_count int, quality_score int, index int"
    rows = [("red rod", ["rod", ""], "Red rod", None, None, "Red", None, None, [], [], [], 4.5, 99, None, 40, 1), ("zzz", [], "Red rod", None, None, None, None, None, [], [], [], None, None, None, 40, 0)]
    got = search.score_documents(spark.createDataFrame(rows, schema)).collect()
    assert [r["score"] for r in got] == [round(120 + 8 * 2 + 18 + 9 + 8 + 2 - 0.001, 2)]
