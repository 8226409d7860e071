"""The product index: substring joins, texts and terms, mapped results, expansions, the ladder, autocomplete and pasted lines."""

from functools import cache

import pytest
from pyspark.sql import functions as F

from quillmart.functions import keys, text
from quillmart.functions.text import SERVICE_REPLACEMENTS, TEXT_REPLACEMENTS, service_key, service_key_of
from quillmart.operators import analytics, index, search
from quillmart.operators.containment import join_inside
from quillmart.operators.matching import CATEGORY_WORDS
from quillmart.plans import index_queries as iq

SF = "/root/testdata/sf0.001"
EMPTY = "k string, t string"


@cache
def database():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "lineitem", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", ["f12_search_text", "f13_search_terms", "j8_alias_terms", "j1_mapped_products", "r4_index_search", "r14_autocomplete", "r22_search_ladder", "r5_expand_queries", "a11_catalog_stats", "f19_ids_and_shades"])
def test_registered_queries_equal_their_sql(spark, name):
    df = iq.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = database().execute(iq.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert rows(df, *columns) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_words_inside_texts(spark):
    texts = ["abcabc", "xaby", "", None, "b", "가나다", "ab"]
    words = ["ab", "b", "", None, "bca", "나다", "zz", "abcabcd"]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    b = spark.createDataFrame([(j, w) for j, w in enumerate(words)], "j int, word string")
    inside = {(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if t and w and w in t}
    begun = {(i, j) for i, j in inside if texts[i].startswith(words[j])}
    assert set(rows(join_inside(a, "text", b, "word"), "i", "j")) == inside
    assert set(rows(join_inside(a, "text", b, "word", start=True), "i", "j")) == begun
    assert join_inside(a, "text", b.where("false"), "word").count() == 0
    assert join_inside(a.where("false"), "text", b, "word").count() == 0


def test_keys_of_fixed_words(spark):
    words = [*CATEGORY_WORDS, "A-b c", "STRASSE ß", *(p[0] for p in TEXT_REPLACEMENTS + SERVICE_REPLACEMENTS)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", service_key(F.col("w")).alias("k"))
    assert {r["w"]: r["k"] for r in df.collect()} == {w: service_key_of(w) for w in words}


def test_records_without_columns_or_values(spark):
    records = spark.createDataFrame([(1, None, None, []), (2, "Ab", "Ab c", ["x", "Ab"])], "k int, source_brand_name string, product_name_ko string, options array<string>")
    got = dict(rows(records.select("k", index.search_terms(records).alias("t")), "k", "t"))
    assert got[1] == []
    assert got[2] == ["ab", "ab c", "c", "abc", "bc", "x ab", "x", "xab", "xa"]
    assert dict(rows(records.select("k", index.search_text(records).alias("t")), "k", "t")) == {1: "", 2: "ababcxab"}
    aliases = spark.createDataFrame([("Ab", "AB"), ("에이비", "AB"), (None, "AB"), ("Zz", "ZZ")], "alias string, official_en string")
    assert rows(index.alias_terms(records, aliases, "k"), "key", "aliases") == [(2, ["에이비", "Ab"])]
    assert index.alias_terms(records.where("false"), aliases, "k").count() == 0
    assert rows(index.index_columns(records, aliases, "k"), "doc", "aliases") == [(1, ""), (2, "에이비 Ab")]


def test_products_are_found_by_alias_gram_option_and_shade(spark):
    """Each of these words stands in no name, brand or category of the product that it finds."""
    records = spark.createDataFrame(
        [("p1", "Clio", "Kill Cover Founwear", ["Refill"], "21 Linen", 3), ("p2", "Hera", "Black Cushion", None, None, 2), ("p3", None, "Velvet Tint", None, None, 1)],
        "record_key string, source_brand_name string, product_name_ko string, options array<string>, shade string, last_seen_at int",
    )
    aliases = spark.createDataFrame([("Clio", "Clio"), ("클리오", "Clio"), ("Hera", "Hera")], "alias string, official_en string")
    postings = index.product_postings(records, aliases, "record_key")
    asked = spark.createDataFrame([(q, q) for q in ("클리오", "unwear", "refill", "linen", "elvetti")], "query_id string, query string")
    got = {(r["query_id"], r["doc"]) for r in search.search_bm25(asked, postings, 1).collect()}
    assert got == {("클리오", "p1"), ("unwear", "p1"), ("refill", "p1"), ("linen", "p1"), ("elvetti", "p3")}
    products = records.withColumn("search_text", F.lit(""))
    ranks = spark.createDataFrame([], "query_key string, product_key string, rank int")
    found = index.search_index(asked, ranks, products, postings, aliases, 1).collect()
    assert {(r["query_id"], r["doc"]) for r in found} == got


def test_equal_scores_go_to_what_was_seen_last(spark):
    records = spark.createDataFrame([("a", "Lip Tint", 1), ("b", "Lip Tint", 3), ("c", "Lip Tint", 3), ("d", "Lip Tint", None), ("e", "Other", 9)], "record_key string, product_name_ko string, last_seen_at int")
    none = spark.createDataFrame([], "alias string, official_en string")
    postings = index.product_postings(records, none, "record_key")
    asked = spark.createDataFrame([("q", "lip tint")], "query_id string, query string")
    seen = records.select(F.col("record_key").alias("doc"), F.col("last_seen_at").alias("seen"))
    best = lambda k, s: [r["doc"] for r in search.search_bm25(asked, postings, k, s).orderBy("rank").collect()]
    assert best(4, seen) == ["c", "b", "a", "d"] and best(1, seen) == ["c"] and best(4, None) == ["d", "c", "b", "a"]


def test_mapped_products_by_rank_time_and_key(spark):
    queries = spark.createDataFrame([("q", "A b"), ("none", "x"), ("empty", ""), ("null", None)], "query_id string, query string")
    ranks = spark.createDataFrame([("ab", 1, 2), ("ab", 2, 1), ("ab", 3, 2), ("ab", 4, 2), ("ab", 9, 0)], "query_key string, product_key int, rank int")
    products = spark.createDataFrame([(1, 5), (2, 1), (3, 7), (4, 5)], "record_key int, last_seen_at int")
    hits = index.mapped_hits(queries, ranks, products, 3)
    assert rows(hits, "query_id", "rank", "doc") == [("q", 1, 2), ("q", 2, 3), ("q", 3, 1)]
    assert rows(index.with_products(hits, products), "doc", "last_seen_at") == [(1, 5), (2, 1), (3, 7)]


def test_expansions_in_order(spark):
    queries = spark.createDataFrame(
        [(1, "Clio pink tint", None, "CLIO", "Clio"), (2, "tint", "Rom", None, None), (3, "", None, None, None), (4, None, None, None, None), (5, "Clio", None, "CLIO", "Clio")],
        "query_id int, query string, brand string, official_en string, matched string",
    )
    aliases = spark.createDataFrame([("클리오", "CLIO"), ("Clio", "CLIO")], "alias string, official_en string")
    related = spark.createDataFrame([("pink tint", ["lip", "TINT"]), ("tint", ["lip"])], "entry string, terms array<string>")
    got = {}
    for q, _, t in rows(index.expand_queries(queries, aliases, related), "query_id", "candidate", "query"):
        got.setdefault(q, []).append(t)
    assert got[1] == ["클리오 pink tint", "클리오 tint", "Clio pink tint", "Clio tint", "pink tint", "tint", "lip", "클리오", "Clio"]
    assert got[2] == ["Rom tint", "tint", "lip", "Rom"]
    assert got[3] == [""] and got[4] == [""]
    assert got[5] == ["클리오", "Clio"]


def ladder(expanded, hits, key_of, limit):
    """What the ladder gives, a query at a time."""
    out = []
    for q in {e[0] for e in expanded}:
        steps = sorted((c, t) for qid, c, t, _ in expanded if qid == q)
        discovery = next(d for qid, _, _, d in expanded if qid == q)
        mapped = any(tier == 0 for _, t in steps for text_, _, tier, _ in hits if text_ == t)
        seen, taken = [], []
        for c, t in steps:
            for _, doc, tier, rank in sorted((h for h in hits if h[0] == t), key=lambda h: h[3]):
                if doc in key_of and (discovery or not mapped or tier == 0):
                    if key_of[doc] not in seen:
                        seen.append(key_of[doc])
                    taken.append((c, rank, doc))
            if len(seen) >= limit:
                break
        out += [(q, seen.index(key_of[d]) + 1, key_of[d], c, r, d) for c, r, d in taken if key_of[d] in seen[:limit]]
    return sorted(out, key=repr)


def test_ladder_by_hand(spark):
    import random

    rng = random.Random(5)
    key_of = {d: f"g{d % 9}" for d in range(30)}
    texts = [f"t{i}" for i in range(12)]
    hits = []
    for t in texts:
        docs = rng.sample(range(33), 6)
        n = rng.choice([0, 0, 2])
        hits += [(t, d, 0 if i < n else 1, i + 1) for i, d in enumerate(docs)]
    expanded = [(q, c, t, q % 2 == 0) for q in range(20) for c, t in enumerate(rng.sample(texts, rng.randint(1, 6)))]
    got = index.search_ladder(
        spark.createDataFrame(expanded, "query_id int, candidate int, query string, discovery boolean"), spark.createDataFrame(hits, "query_id string, doc int, tier int, rank int"),
        spark.createDataFrame(list(key_of.items()), "record_key int, collection_key string"), 7,
    )
    assert rows(got, "query_id", "no", "key", "candidate", "rank", "doc") == ladder(expanded, hits, key_of, 7)
    none = spark.createDataFrame([], "query_id string, doc int, tier int, rank int")
    assert index.search_ladder(spark.createDataFrame(expanded, "query_id int, candidate int, query string, discovery boolean"), none, spark.createDataFrame(list(key_of.items()), "record_key int, collection_key string"), 7).count() == 0


def test_autocomplete_and_lines(spark):
    products = spark.createDataFrame(
        [(1, "Clio", "Clio Tint", "tint", 3, 1), (2, None, "clio-tint", "Tint", 9, 2), (3, "Rom", "Tint", None, 5, 3)],
        "record_key int, source_brand_name string, product_name_ko string, category string, quality_score int, source_priority int",
    )
    hits = spark.createDataFrame([("cl", 1, 2), ("cl", 2, 1), ("tint", 3, 1), ("tint", 1, 2)], "query_id string, doc int, rank int")
    prefixes = spark.createDataFrame([("cl", "cl"), ("tint", "tint"), ("e", "")], "prefix_id string, prefix string")
    assert rows(index.autocomplete(prefixes, hits, products, 2), "prefix_id", "rank", "text") == [("cl", 1, "clio-tint"), ("cl", 2, "Clio"), ("tint", 1, "Tint"), ("tint", 2, "Clio Tint")]
    pasted = spark.createDataFrame([("a", "1. clio tint\n- clio tint\n* nothing like it"), ("b", ""), ("c", None)], "text_id string, text string")
    lines = index.lines_of(pasted, 5)
    assert rows(lines, "text_id", "line") == [("a", "clio tint"), ("a", "nothing like it")]
    found = spark.createDataFrame([("clio tint", 3, 1), ("clio tint", 1, 2), ("nothing like it", 3, 1)], "query_id string, doc int, rank int")
    assert rows(index.search_lines(lines, found, products, ["source_brand_name", "product_name_ko"]), "text_id", "line", "doc") == [("a", "clio tint", 1)]


def test_catalog_keys_and_stats_of_nothing(spark):
    df = spark.createDataFrame([("s", "7", "u", "c", "b", "n"), ("s", "", "u", "c", "b", "n"), ("s", None, None, "c", None, "n")], "s string, i string, u string, c string, b string, n string")
    c = F.col
    assert [r[0] for r in df.select(keys.catalog_key(c("s"), c("i"), c("u"), c("c"), c("b"), c("n"))).collect()] == ["s:7", "s:u", "s:c:n"]
    assert [r[0] for r in df.select(keys.target_key(F.lit("image_url"), F.lit(""), c("s"), c("i"), c("n"))).collect()] == ["image_url:s:7:n", "image_url:s:n", "image_url:s:n"]
    items = spark.createDataFrame([], "source string, source_url string, canonical_product_id string, product_name_en string, offer_sources array<string>")
    assert rows(analytics.catalog_stats(items), "measure", "n") == [("canonical_product_id", 0), ("product_name_en", 0), ("total", 0)]
    assert spark.range(1).select(text.product_id_in(F.lit("x")), text.shade_mentions(F.array(F.lit("no")))).first() == (None, None)
