"""Imports, evidence and matches by hand: payloads of any depth, row errors with lines, audit reasons, confirmed mappings, forced reviews."""

import json
import random

from pyspark.sql import functions as F

from quillmart.operators import evidence, matches
from quillmart.sources import payloads, tables

KEYS = payloads.LIST_KEYS


def items_by_hand(node):
    if isinstance(node, list):
        return node
    if isinstance(node, dict):
        for k in KEYS:
            v = node.get(k)
            if isinstance(v, list):
                return v
            if isinstance(v, dict) and (found := items_by_hand(v)):
                return found
    return []


def random_payload(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([[], [{"id": rng.random()}], [1, {"id": 2}], "text", None, 5, {}])
    return {rng.choice((*KEYS, "other")): random_payload(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_items_are_found_at_any_depth(spark):
    rng = random.Random(1)
    deep = [{"id": "x"}]
    for i in range(40):
        deep = {KEYS[i % 4]: deep}
    made = [deep, {"products": [], "items": [1]}, {"data": {"products": []}, "results": [{"id": 1}]}, [[1]], [], {}, 7, "s"] + [random_payload(rng, 6) for _ in range(400)]
    texts = [json.dumps(p) for p in made] + [None, "", "{broken", " [1] "]
    want = [len(items_by_hand(p)) for p in made] + [0, 0, 0, 1]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", F.coalesce(F.size(payloads.items_of(F.col("t"))), F.lit(0)).alias("n")).orderBy("i").collect()]
    assert [max(n, 0) for n in got] == want
    assert sum(n > 0 for n in want) > 40


def test_row_errors_have_their_lines(spark, tmp_path):
    head = ",".join(tables.CANDIDATE_FIELDS)
    good = "c,s,{},https://x/{},title,0.5,12.5,x,,,yes,"
    lines = [good.format(i, i) for i in range(200)]
    lines[3], lines[150], lines[170], lines[199] = "c,,3,https://x,title,0.5,,,,,,", "c,s,3,ftp://x,title,0.5,,,,,,", "c,s,3,https://x,title,high,,,,,,", "c,s,3,https://x,title,1.5,,,,,,"
    (tmp_path / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        valid, invalid = tables.split_candidates(tables.read_match_candidates(spark, f"{tmp_path}/a.csv"))
        assert {r["line"]: r["source_product_id"] for r in valid.collect()} == {i + 2: str(i) for i in range(200) if i not in (3, 150, 170, 199)}
        assert sorted((r["line"], r["reason"]) for r in invalid.collect()) == [
            (5, "missing required field: source"), (152, "source_url does not look like a URL: 'ftp://x'"), (172, "confidence is not a number: 'high'"), (201, "confidence out of range [0.0, 1.0]: 1.5"),
        ]
        row = valid.where("line = 2").first()
        assert (row["confidence"], row["original_price"], row["sale_price"], row["sold_out"], row["currency"]) == (0.5, 12.5, None, True, None)
        record = {"canonical_product_id": " c ", "source": "s", "source_product_id": 7, "source_url": "https://x", "match_method": "m", "confidence": 1}
        (tmp_path / "b.jsonl").write_text("\n".join(["", *[json.dumps(record), ""] * 40, "nonsense", json.dumps(record | {"confidence": None})]))
        valid, invalid = tables.split_candidates(tables.read_match_candidates(spark, f"{tmp_path}/b.jsonl"))
        assert sorted(r["line"] for r in valid.collect()) == list(range(2, 82, 2)) and valid.first()["canonical_product_id"] == "c"
        assert sorted((r["line"], r["reason"]) for r in invalid.collect()) == [(82, "missing required field: canonical_product_id"), (83, "missing required field: confidence")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_audit_gives_candidates_or_reasons(spark):
    named = lambda *names: [("json_ld", n) for n in names]
    pages = [
        ("u1", named("Clio", "클리오 Kill Cover", "Kill Cover Founwear Cushion"), [("og:image", "https://i/1.jpg")], [("price", "0", None), ("price", "12,000", "KRW")], None),
        ("u2", named("Clio Official Store"), [("og:image", "//i/1.jpg")], [("price", "free", None)], None),
        ("u3", named("킬커버 쿠션"), [], [], None),
        ("u4", named("킬커버 Cushion"), [], [], None),
        ("u5", named("킬커버 Cushion", "쿠션"), [], [], None),
        ("u6", [], [], [], "timeout"),
        ("u7", named("Kill Cover"), [], [], None),
        (None, named("Kill Cover Cushion"), [], [], None),
    ]
    schema = "source_url string, names array<struct<source:string,name:string>>, images array<struct<source:string,url:string>>, prices array<struct<source:string,price:string,currency:string>>, error string"
    brand = {"u7": "클리오"}
    asked = [(u, f, "oliveyoung:global", brand.get(u), "Clio") for u in ("u1", "u2", "u3", "u4", "u5", "u6", "u7", "u9", "", None) for f in (*evidence.FIELDS, "brand_en")] + [("u1", "price", "s", None, None)] * 2
    targets = spark.createDataFrame([(*a, "clash") for a in asked], "source_url string, field string, source string, brand_ko string, brand_en string, reason string").repartition(3)
    rows = evidence.audit_targets(targets, spark.createDataFrame(pages, schema)).collect()
    assert len(rows) == len(asked)
    got = {(r["source_url"], r["field"]): (r["usable"], r["reason"]) for r in rows}
    name, image, price = evidence.FIELDS
    assert [got["u1", f] for f in (*evidence.FIELDS, "brand_en")] == [(True, ""), (True, ""), (True, ""), (False, "")]
    assert [got["u2", f] for f in evidence.FIELDS] == [(False, "latin_evidence_rejected_low_confidence"), (False, "invalid_image_url_evidence"), (False, "non_positive_price_evidence")]
    assert [got[u, name][1] for u in ("u3", "u4", "u5", "u6", "u9", "", None)] == ["korean_only_evidence", "mixed_language_without_latin_product_name", "korean_or_mixed_evidence_only", "fetch_error", "fetch_error", "no_evidence", "no_evidence"]
    assert got["u3", image][1] == "no_image_evidence" and got["u4", price][1] == "no_price_evidence" and got["u6", price][1] == "fetch_error"
    assert got["u7", name] == (False, "latin_evidence_rejected_low_confidence")  # a Hangul brand's Latin key is empty, so names of two words begin with it
    first = next(r for r in rows if (r["source_url"], r["field"]) == ("u1", name))
    assert (first["candidate_name"], first["candidate_price"], first["candidate_currency"], first["evidence_count"], first["evidence_languages"]) == ("Kill Cover Founwear Cushion", "12,000", "KRW", 3, "latin | mixed | latin")
    assert {r["error"] for r in rows if r["source_url"] == "u9"} == {"not_crawled"} and {r["error"] for r in rows if not r["source_url"]} == {None}
    assert evidence.audit_targets(targets.limit(0), spark.createDataFrame(pages, schema)).collect() == []


LEDGER = "match_id string, canonical_product_id string, offer_id string, confidence double, match_method string, review_state string, reviewed_by string, evidence array<struct<type:string,value:string>>"


def confirmed_by_hand(offers, known, mappings):
    offers, known, outcomes = list(offers), dict(known), []
    for canonical, source, number, url in mappings:
        if not (canonical and number and url):
            outcomes.append("incomplete")
            continue
        same = [c for c, s, n in offers if (s, n) == (source, number)]
        if same and canonical not in same:
            outcomes.append("conflict")
            continue
        if not same:
            offers.append((canonical, source, number))
        known.setdefault(f"match:{canonical}:{source}:{number}", "verified")
        outcomes.append("linked")
    return sorted(offers), known, outcomes


def test_confirmed_mappings_make_offers_and_matches(spark):
    rng = random.Random(3)
    offers = [("c1", "s", "1"), ("c2", "s", "1"), ("c3", "s", "2")]  # the first number has two owners already
    known = {"match:c1:s:1": "rejected"}
    mappings = [(rng.choice(["c1", "c2", "c3", "", None]), rng.choice(["s", "t"]), rng.choice(["1", "2", "3", None]), rng.choice(["u", "u", "u", ""])) for _ in range(60)]
    want_offers, want_known, outcomes = confirmed_by_hand(offers, known, mappings)
    table = spark.createDataFrame([(*o, ":".join(o)) for o in offers], "canonical_product_id string, source string, source_product_id string, offer_id string")
    ledger = spark.createDataFrame([(m, "c1", "c1:s:1", 0.5, "title", state, None, None) for m, state in known.items()], LEDGER)
    rows = [(*m, i, f"t{i:02}") for i, m in enumerate(mappings)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        asked = spark.createDataFrame(rows, "canonical_product_id string, source string, source_product_id string, source_url string, seq int, created_at string").repartition(3)
        made_offers, made, judged = matches.backfill_confirmed(ledger, table, asked, "editor", ("seq",))
        assert sorted((r["canonical_product_id"], r["source"], r["source_product_id"]) for r in made_offers.collect()) == want_offers
        assert {r["match_id"]: r["review_state"] for r in made.collect()} == want_known
        assert [r["outcome"] for r in judged.orderBy("seq").collect()] == outcomes
    assert {"incomplete", "conflict", "linked"} == set(outcomes)
    new = made.where("match_method = 'editor_confirmed'").first()
    assert new["evidence"][0]["type"] == "editor_confirmed_mapping" and new["reviewed_by"] == "editor" and new["offer_id"]
    again_offers, again, _ = matches.backfill_confirmed(made, made_offers, asked, "other", ("seq",))
    assert again_offers.count() == len(want_offers) and sorted(r["match_id"] for r in again.collect()) == sorted(want_known) and again.where("reviewed_by = 'other'").count() == 0


def test_forced_reviews_set_any_state(spark):
    ledger = spark.createDataFrame([("a", "rejected", "x", 1), ("b", "verified", "x", 1), ("c", "pending_review", None, 1)], "match_id string, review_state string, reviewed_by string, updated_at int")
    asked = [("a", "verified", "me", 5, 1), ("a", "invalid", "me", 6, 2), ("b", "verified", " ", 7, 3), ("b", "gone", "me", 8, 4), ("z", "verified", "me", 9, 5), ("b", None, "me", 9, 6)]
    after, judged = matches.force_reviews(ledger, spark.createDataFrame(asked, "match_id string, decision string, reviewer string, decided_at int, seq int"), ("seq",))
    assert sorted(map(tuple, after.collect()), key=str) == [("a", "invalid", "me", 6), ("b", "verified", "x", 1), ("c", "pending_review", None, 1)]
    assert [r["outcome"] for r in judged.orderBy("seq").collect()] == ["updated", "updated", "no_reviewer", "invalid_state", "not_found", "invalid_state"]


def test_targets_of_pending_matches(spark):
    rows = spark.createDataFrame([("m1", "c1"), ("m2", "c2"), ("m3", None)], "match_id string, canonical_product_id string")
    products = spark.createDataFrame([("c1", 1, "k", "old"), ("c1", 2, "k", "new"), (None, 3, "k", "none")], "canonical_product_id string, last_seen_at int, record_key string, product_name_ko string")
    got = {r["match_id"]: r["target"] and r["target"]["product_name_ko"] for r in matches.with_targets(rows, products).collect()}
    assert got == {"m1": "new", "m2": None, "m3": None}
