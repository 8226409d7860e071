"""What is computed once for equal inputs, before joins, and joins by measured size: the same rows as the plain way."""

import collections
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmart import registry
from quillmart.operators import editor, matching, merge, search, upsert
from quillmart.plans import catalog_queries as cq
from quillmart.shared import MEASURED_BROADCAST, PLANNED_BROADCAST, once_for_each, spread

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_queries_measure_their_joins(spark):
    registry.QUERIES["s2_alias_table"](spark, SF)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == PLANNED_BROADCAST
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == MEASURED_BROADCAST


def test_once_for_each_distinct_input(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, None), (5, "b", "x"), (5, "b", "x")], "id long, l string, r string")
    made = once_for_each(df, {"l": F.col("l"), "both": F.concat_ws("+", "l", "r")}, {"shown": F.concat_ws("|", "l", "both")})
    assert made.columns == ["id", "l", "r", "shown"]
    assert rows(made) == rows(df.withColumn("shown", F.concat_ws("|", "l", F.concat_ws("+", "l", "r"))))
    assert spread(df).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_catalog_keys_of_several_rows_come_once(spark):
    catalog = spark.createDataFrame([(1, "g", "red ring"), (1, "h", "red ring"), (1, None, "red bolt"), (2, "g", "blue"), (3, None, "red ring"), (4, None, "ring"), (3, None, "red ring")], "id long, grp string, text string")
    asked = spark.createDataFrame([("q", "red ring")], "query_id string, query string")
    assert rows(matching.search_catalog(asked, catalog, "text", "id", "grp")) == [("q", 1), ("q", 2), ("q", 3)]


LINE = "line_id long, brand_query string, product_query string, shade_code string, shade_name string, require_brand boolean, step int"
PRODUCT = "product_id long, brand_ko string, brand_en string, name_ko string, name_en string, shade string, category string, source_url string, image_url string, quality_score int, source_priority int"


def test_kinds_of_lines_are_judged_like_pairs(spark):
    lines = [(n, ["Rom", None, "Lee", ""][n % 4], ["red ring", "blue bolt x"][n % 2], [None, "21"][n % 3 % 2], None, n % 5 != 0, 0) for n in range(60)]
    parts = [(n, None, ["Rom", "Lee Rom"][n % 2], None, ["red ring", "blue bolt x"][n % 3 % 2], ["21", None, "4"][n % 3], "c", ["u", "", "u", None][n % 4], [None, "i"][n % 2], [n % 7, None][n % 11 == 0], [None, 20, 90][n % 3]) for n in range(90)]
    asked, products = spark.createDataFrame(lines, LINE), spark.createDataFrame(parts, PRODUCT)
    pairs = asked.join(products, asked["product_query"] == products["name_en"])
    plain = editor.judge_candidates(pairs).select("line_id", "step", "product_id", "brand_matches", "shade_matches", "match_score")
    kinds, judged = editor.judge_lines(asked, products, "product_query", "name_en")
    assert kinds.select("kind").distinct().count() < 60
    assert rows(kinds.join(judged, "kind").drop("kind").select(plain.columns)) == rows(plain)
    best = editor.resolve_kinds(*editor.judge_lines(asked, products, "product_query", "name_en", most=5), 5)
    assert rows(best) == rows(editor.resolve_lines(asked, plain, 5))


def test_pairs_of_lines_and_products_are_not_shuffled(spark, monkeypatch):
    """Every pair is listed where its kinds meet; a name with many pairs, its lists cut short, is dealt to several tasks."""
    lines = [(n, ["Rom", None, "Lee", ""][n % 4], None if n % 8 == 7 else ["red ring", "blue bolt x"][n % 16 == 5], [None, "21"][n % 3 % 2], None, n % 5 != 0, 0) for n in range(160)]
    parts = [(n, None, ["Rom", "Lee Rom"][n % 2], None, ["red ring", "red ring", None, "blue bolt x"][n % 4], ["21", None, "4"][n % 3], "c", ["u", "", "u", None][n % 3], [None, "i"][n % 2], [n % 7, None][n % 11 == 0], [None, 20, 90][n % 3]) for n in range(300)]
    asked, products = spark.createDataFrame(lines, LINE), spark.createDataFrame(parts, PRODUCT)
    plain = editor.judge_candidates(asked.join(products, asked["product_query"] == products["name_en"])).select("line_id", "step", "product_id", "brand_matches", "shade_matches", "match_score")
    for listed, pairs in ((1_000, 50_000_000), (3, 100)):
        monkeypatch.setattr(editor, "LISTED", listed)
        monkeypatch.setattr(editor, "TASK_PAIRS", pairs)
        got = editor.judge_all(asked, products, "product_query", "name_en")
        assert rows(got) == rows(plain) and plain.count() > 5_000
        assert len({r["at"] for r in got.select(F.spark_partition_id().alias("at")).distinct().collect()}) > 1
    assert editor.judge_all(asked.where("false"), products, "product_query", "name_en").count() == 0
    plan = registry.QUERIES["r19_editor_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "Repartition" not in plan[: plan.index("Join")]


def test_keys_made_before_the_join_score_alike(spark):
    empty = F.array().cast("array<string>")
    asked = spark.createDataFrame([("red ring", ["rom"]), ("lee", [])], "query string, expanded_terms array<string>")
    none = F.lit(None).cast("string")
    docs = spark.createDataFrame([(1, "Red Ring", "Rom"), (2, "bolt", "Lee"), (3, None, "Rom")], "index long, name string, brand string").select(
        "index", "name", none.alias("name_en"), "brand", none.alias("brand_en"), none.alias("category"), none.alias("description"), empty.alias("tags"), empty.alias("ingredients"), empty.alias("review_keywords"),
        F.lit(4.0).alias("rating"), F.lit(10).alias("review_count"), F.lit(None).cast("int").alias("sales_count"), F.lit(40).alias("quality_score"),
    )
    early = search.score_documents(search.with_asked_keys(asked).crossJoin(search.with_document_keys(docs)))
    late = search.score_documents(asked.crossJoin(docs))
    assert early.columns == late.columns and rows(early) == rows(late) and early.count() > 2
    pairs = asked.select(F.col("query").alias("product_query")).crossJoin(docs)
    keyed = matching.with_query_classes(asked.select(F.col("query").alias("product_query"))).crossJoin(matching.with_haystack(docs, ["name", "brand"]))
    assert rows(matching.match_scores(keyed, ["name", "brand"])) == rows(matching.match_scores(pairs, ["name", "brand"]))


def test_display_names_are_made_once_for_equal_texts(spark):
    """Copies of a part's texts are one row before the rules are applied."""
    plan = registry.QUERIES["f22_display_names"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made, dealt = plan.index("lambdafunction"), plan.index("Repartition")
    assert made < dealt and "Aggregate" in plan[dealt:]


def test_heads_of_equal_documents_answer_for_all(spark):
    texts = ["red ring", "red ring", "blue bolt", None, "red ring large", "blue bolt", "red", None]
    docs = spark.createDataFrame([(n, texts[n % 8], n % 5 if n % 7 else None) for n in range(64)], "doc long, name string, seen int")
    asked = spark.createDataFrame([("a", "red ring"), ("b", "bolt"), ("c", "large red"), ("d", "none")], "query_id string, query string")
    heads, members = search.equal_documents(docs, "doc", ["name"])
    assert heads.count() == 5 and members.count() == 64
    for seen in (docs.select("doc", "seen"), None):
        plain = search.search_bm25(asked, search.build_postings(docs, "doc", F.col("name")), 6, seen)
        short = search.search_bm25(asked, search.build_postings(heads, "doc", F.col("name")), 6, seen, members)
        told = lambda df: rows(df.select("query_id", "doc", F.round("score", 9), "rank"))
        assert told(short) == told(plain) and len(told(plain)) == 18


def test_documents_are_scored_in_their_blocks(spark, monkeypatch):
    """No table of queries by documents is written, equal scores or not; blocks and shares of any size give the best of all pairs."""
    docs = spark.createDataFrame([(n, ["red ring", "red bolt", "blue ring", "red ring ring", None][n % 5], n % 7 if n % 3 else None) for n in range(500)], "doc long, name string, seen int")
    asked = spark.createDataFrame([(f"{i:02}", f"{['red ring', 'bolt', 'large blue'][i % 3]} x{i}") for i in range(30)], "query_id string, query string")
    postings = search.build_postings(docs, "doc", F.col("name"))
    terms = asked.select("query_id", F.explode(search.query_terms(F.col("query"))).alias("term"))
    lengths = postings.select("doc", "doc_len").distinct().agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean"))
    pairs = terms.join(postings, "term").join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(lengths)
    weight = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(search.LEAST_IDF)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("doc_len") / F.col("mean")))
    scored = pairs.groupBy("query_id", "doc").agg(F.round(F.sum(weight), 9).alias("score")).join(docs.select("doc", "seen"), "doc")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("seen").desc_nulls_last(), F.desc("doc"))
    want = rows(scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "doc", "score", "rank"))
    made, keep = [], search.stored

    def counted(df, what):
        out = keep(df, what)
        made.append(out.count())
        return out

    monkeypatch.setattr(search, "stored", counted)
    for block, share in ((8_192, 1_000_000), (70, 100)):
        monkeypatch.setattr(search, "BLOCK_DOCUMENTS", block, raising=False)
        monkeypatch.setattr(search, "BLOCK_TERMS", share, raising=False)
        got = search.search_bm25(asked, postings, 3, docs.select("doc", "seen"))
        assert rows(got.select("query_id", "doc", F.round("score", 9), "rank")) == want and len(want) == 90
    assert max(made) < 30 * 50


def test_substrings_are_searched_from_the_greatest_order_on(spark, monkeypatch):
    """Common keys end with the first documents, rare and short ones go on to the last; the rows are those of all pairs."""
    texts = ["redring", "ringbolt", None, "bolt", "reding", "abolt", "", "ring"]
    docs = [(n, texts[n % 8] if n else "onlyone", [None, 1, 2][n % 3]) for n in range(200)]
    asked = [(q, q) for q in ("ring", "red ring", "bo", "o", "onlyone", "zz", "zebra", " ", "tring")]
    made = spark.createDataFrame(docs, "doc long, search_text string, seen int"), spark.createDataFrame(asked, "query_id string, query string")
    for order, place in (((), lambda d: d[0]), (("seen",), lambda d: (d[2] or 0, d[0]))):
        want = []
        for q, text in asked:
            key = text.replace(" ", "")
            hits = sorted((d for d in docs if key and key in (d[1] or "")), key=place, reverse=True)
            want += [(q, d[0], no) for no, d in enumerate(hits[:4], 1)]
        for first, keys in ((search.FIRST_DOCUMENTS, search.BROADCAST_KEYS), (6, search.BROADCAST_KEYS), (6, 0)):
            monkeypatch.setattr(search, "BROADCAST_KEYS", keys)
            assert rows(search.search_substring(made[1], made[0], 4, "doc", "search_text", order, first=first)) == sorted(want, key=repr)
            monkeypatch.undo()


def test_payloads_and_pages_are_made_on_all_cores(spark):
    """A small file of parts is one task; what is read out of texts is dealt out first."""
    for name in ("s7_nested_payloads", "a16_evidence_audit"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name


def test_keys_of_listings_are_made_for_parts(spark):
    """Line items are joined to parts that have their keys already, and the keys are those of the plain way."""
    for name in ("a1_upsert_products", "a3_query_ranks", "k_record_keys"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "__name" in plan[plan.index("Join") :], name
    plain = cq.keyed(cq.observations(spark, SF)).select("seq", "part_no", "supp_no", "record_key")
    assert rows(cq.keyed_observations(spark, SF).select(plain.columns)) == rows(plain)


def test_products_of_a_key_are_dealt_once(spark):
    """a5: keys are made for parts; rows with a key are shuffled once, those without never."""
    plan = registry.QUERIES["a5_merge_products"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "__name" in plan[plan.index("Join") :]
    schema = "key string, at double, source string, source_priority int, quality_score int, category string"
    rows_of = [("k", 1.0, "a", 20, 5, None), ("k", 2.0, "b", 10, 1, None), ("k", 3.0, "c", 10, 9, "x"), (None, 1.0, "a", None, 2, "y"), (None, 1.0, "a", None, 2, "y"), ("", 1.0, "d", None, None, None)]
    merged = merge.merge_products(spark.createDataFrame(rows_of, schema), "key", ("at",), ["category"])
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = [("k", "x", "c", 10, 9, 3, (1.0,)), ("", None, "d", None, None, 1, (1.0,)), *[(None, "y", "a", None, 2, 1, (1.0,))] * 2]
    assert rows(merged) == sorted(want, key=repr)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


OBSERVED = "record_key string, seq int, observed_at int, source string, canonical_product_id string, source_product_id string, source_url string, category string, original_price double, sale_price double, regular_price double"


def observed(spark, n=300):
    rng = random.Random(9)
    pick = lambda *x: rng.choice(x)
    made = [(f"k{rng.randrange(90)}", i, i // 3, pick("s", "t"), pick("c1", "c1", "c2", None), pick("p1", "p2", "", None), pick("u", "v", None), pick("x", "", None), pick(1.0, 2.0, None), pick(3.0, None), pick(4.0, None)) for i in range(n)]
    return spark.createDataFrame(made, OBSERVED).repartition(3)


def test_records_of_unlike_keys_are_dealt_as_they_are(spark):
    """a4: rows cross the shuffle, not a partial result with an order tuple for each column; the fold is the same."""
    records = observed(spark)
    dealt = upsert.merge_records(records, ("seq",), keys_repeat=False)
    for plan in (physical(dealt), physical(registry.QUERIES["a4_merge_records"](spark, SF))):
        at = plan.index("hashpartitioning(record_key")
        assert plan.count("hashpartitioning(record_key") == 1 and plan[:at].count("Aggregate(") == 2 and "Aggregate(" not in plan[at:]
    assert rows(dealt) == rows(upsert.merge_records(records, ("seq",))) and dealt.count() > 80


def test_offers_are_dealt_by_source_and_id_once(spark):
    """a2: the owner and the fold share one shuffle; offers and conflicts are those of the owner found first and joined."""
    seen = observed(spark).drop("record_key", "regular_price")
    offers, conflicts = upsert.upsert_offers(seen, ("seq",))
    assert physical(offers).count("Exchange hashpartitioning") == physical(conflicts).count("Exchange hashpartitioning") == 1
    first, want = {}, {}
    for r in sorted(seen.collect(), key=lambda r: r["seq"]):
        if None in (r["canonical_product_id"], r["source_product_id"], r["source_url"]):
            continue
        pair = r["source"], r["source_product_id"]
        if first.setdefault(pair, r["canonical_product_id"]) == r["canonical_product_id"]:
            was = want.get(pair, {})
            known = {c: was.get(c) if r[c] is None else r[c] for c in ("source_url", "category", "original_price")}
            want[pair] = known | {"sale_price": r["sale_price"], "first": was.get("first", r["observed_at"]), "last": r["observed_at"]}
    got = {(r["source"], r["source_product_id"]): r for r in offers.collect()}
    assert got.keys() == want.keys() and len(got) == offers.count() == 6
    for pair, w in want.items():
        r = got[pair]
        assert r["offer_id"] == ":".join((first[pair], *pair)) and r["canonical_product_id"] == first[pair]
        assert {c: r[c] for c in ("source_url", "category", "original_price", "sale_price")} | {"first": r["first_seen_at"], "last": r["last_seen_at"]} == w
    whole = [r for r in seen.collect() if None not in (r["canonical_product_id"], r["source_product_id"], r["source_url"])]
    assert conflicts.columns == seen.columns and conflicts.count() == sum(first[r["source"], r["source_product_id"]] != r["canonical_product_id"] for r in whole) > 10


def test_postings_are_counted_in_their_document(spark):
    """r1: no shuffle and no aggregation whose memory grows with the documents of a task; long documents take no longer a word."""
    rng = random.Random(2)
    texts = {1: "b a B a c", 2: "", 3: None, 4: "one", 5: " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000)), 6: "가나 가나 x-x"}
    made = search.build_postings(spark.createDataFrame(list(texts.items()), "id long, name string"), "id", F.col("name"))
    for df in (made, registry.QUERIES["r1_postings"](spark, SF)):
        assert "Exchange" not in physical(df) and "Aggregate" not in physical(df)
    split = {d: (t or "").lower().replace("-", " ").split() for d, t in texts.items()}
    want = {(w, d, n, len(s)) for d, s in split.items() for w, n in collections.Counter(s).items()}
    got = made.select("term", "doc", "tf", "doc_len").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 3000
