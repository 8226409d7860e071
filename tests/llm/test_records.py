"""op2, op5, op6, op7 and the pipeline: brute force, round trips, held-out accuracy, odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmart.llm import chat, decontaminate, hamming_topk, line_dedup, simhash, toxicity, warc
from quillmart.llm.bpe import ByteBPE
from quillmart.llm.common import fresh_path

# ---- exact top-k


@pytest.mark.parametrize("n, dims", [(300, 24), (4, 24), (0, 24), (90, 64)])
def test_top_k_is_exact(spark, n, dims):
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    vectors = [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 5]]) for i in range(n)]
    vectors += [(1000 + i, list(vectors[0][1])) for i in range(40 if n > 100 else 0)]
    odd = [(5000, None), (None, [1.0] * dims), (5001, [None, float("nan"), *[0.0] * (dims - 2)]), (5002, [])] if n else []
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash")).repartition(3)
    codes = hamming_topk.sign_codes(df)
    base = {r["id"]: r["code"] % 2**64 for r in codes.collect()}
    for i, v in vectors + odd:
        if i is not None and v is not None:
            assert base[i] == sum(1 << b for b, x in enumerate(v) if x is not None and not x <= 0)
    assert len(base) == n + (42 if n > 100 else 2 if n else 0)
    asked = codes.where("id % 7 = 0")
    got = collections.defaultdict(list)
    for r in hamming_topk.top_k(codes, asked, k=6, bits=dims if dims < 64 else 64, segments=3).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["id"]))
    want = {q: [(k + 1, *x) for k, x in enumerate(sorted(((base[q] ^ c).bit_count(), i) for i, c in base.items())[:6])] for q in base if q % 7 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_long_vectors_are_refused(spark):
    with pytest.raises(Exception, match="at most 64 bits"):
        hamming_topk.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>")).collect()


# ---- archives


@pytest.mark.parametrize("versions", [(1,), (2,), (2, 1)])
def test_archives_give_pages_back(spark, versions):
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nX-Page-Id: 4\r\n" + "é" * 700
    pages = [
        (1, "http://a/ b\n?q=ü", "x" * 1000), (2, "u2", "x" * 1000), (9, "u9", "x" * 1000), (3, "u3", "x" * 999), (4, "u4", "x" * 999), (5, None, None), (6, "", ""),
        (-7, "neg", tricky), (2**62, "big", tricky), (None, "none", "x" * 1000), (9, "u9", "x" * 1000), (11, "l", "long " * 300_000),
        (20, "http://x/a b", "y" * 2000), (19, "u19", "y" * 2000), (31, None, "z" * 2000), (30, "u30", "z" * 2000),
    ]
    df = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, digest string, record string").repartition(3)
    path = fresh_path(spark, "test-warc")
    warc.write_archives(df, path, versions=versions, file_records=3)
    got = warc.read_archives(spark, path).collect()
    last = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(i, last.get(html, i))
    want = []
    for i, _, html in pages:
        payload = (html or "").encode()
        refers = last[html] if html in last and i is not None and last[html] != i else None
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == collections.Counter(want)
    assert all(r["date"] == "2020-01-01T00:00:00Z" and r["record_id"].startswith("<urn:uuid:") for r in got)
    ids = {r["record_id"]: r["page_id"] for r in got if r["record_type"] == "response"}
    assert all(ids[r["refers_to_id"]] == r["refers_to"] for r in got if r["record_type"] == "revisit")
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    for content in files:  # a member a record, the first one of warcinfo
        members, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            members.append(member.decompress(rest))
            rest = member.unused_data
            assert member.eof
        assert b"WARC-Type: warcinfo" in members[0] and 2 <= len(members) <= 4
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    empty = fresh_path(spark, "test-warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).collect() == []


def test_copies_of_a_payload_and_short_pages_do_not_meet_in_one_task(spark):
    """Short pages are not dealt by their missing digest, and what is joined by digest is dealt anew, so it can be divided."""
    pages = spark.createDataFrame([(i, "u", "s" if i % 2 else "x" * 1500) for i in range(4000)], "page_id long, url string, html string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = warc.mark_revisits(pages)
        assert marked.where("is_revisit").count() == 1999 and marked.where("refers_to = 3998").count() == 1999
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(digest") == 3  # of the sums, of what they give, and of long pages
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_records_take_several_members(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    packed = warc.gzip_members(bytes(range(256)) * 20)
    assert packed[-1] == 0 and packed.count(b"\x1f\x8b\x08") >= 6
    assert b"".join(warc._inflated(packed)) == bytes(range(256)) * 20


def test_arc_headers_are_read_by_their_own_names():
    arc = warc.write_arc([("http://x/y", "20200102030405", "text/html", b"one\nhttp://z 0 0 t 9\n"), ("u", "20200102030405", "t", b"")], 2)
    records = list(warc.read_arc(arc))
    assert [r.block for r in records] == [b"one\nhttp://z 0 0 t 9\n", b""]
    assert records[0].fields["Result-code"] == "200" and records[0].fields["URL"] == "http://x/y"
    with pytest.raises(ValueError):
        list(warc.read_arc(arc[:-8]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"http://x 0 20200101000000 t 1\nq\n"))
    for n in (0, 5, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id(n, "u", "d")) == n


# ---- toxicity


def labelled(seed, n=600):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rude = ["grumblefitz", "snarkwobble", "vilethorn"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        words = [rng.choice(calm) for _ in range(60)]
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(rude)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_separates_held_out_rows(spark):
    rows = labelled(1)
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows] + [(10_000, None, None, None), (10_001, "", None, None), (None, "no id", None, None)], "doc_id long, text string, source string, toxicity double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(5, None), (None, 1), (20_000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, h in flags.items())


def test_toxicity_takes_one_text_of_an_id(spark):
    made = spark.createDataFrame(labelled(5, 200), "doc_id long, text string, toxic int")
    labels, rows = made.select("doc_id", "toxic"), made.select("doc_id", "text")
    often = rows.unionByName(rows.where("doc_id < 50").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40)))).select("doc_id", F.concat(F.lit("~"), "text").alias("text")))
    once, again = toxicity.train(rows, labels), toxicity.train(often, labels)
    assert once.slots.tolist() == again.slots.tolist() and np.allclose(once.weights, again.weights)


def test_toxicity_without_labels_or_features(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["toxicity"] < 0.5 for r in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert not len(toxicity.fit(spark.createDataFrame([(1, "ab"), (0, "cd")], "s int, text string"), 0.5).slots)


def test_risk_does_not_go_below_zero():
    rng = np.random.default_rng(0)
    xp, xu = (rng.random((40, 300)) < 0.05).astype(np.float32), (rng.random((80, 300)) < 0.05).astype(np.float32)
    w, b = toxicity.nnpu(xp, xu, 0.3)
    clean = np.logaddexp(0, xu @ w + b).mean() - 0.3 * np.logaddexp(0, xp @ w + b).mean()
    assert clean > -0.1


def test_risk_and_gradient_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    xp, xu = (rng.random((9, 6)) < 0.4).astype(np.float32), (rng.random((14, 6)) < 0.4).astype(np.float32)
    w, b, prior = rng.normal(size=6), 0.3, 0.2

    def parts(w, b):
        loss = lambda x, y: math.log1p(math.exp(-y * (float(np.dot(x, w)) + b)))
        return prior * sum(loss(x, 1) for x in xp) / len(xp), sum(loss(x, -1) for x in xu) / len(xu) - prior * sum(loss(x, -1) for x in xp) / len(xp)

    toxic, toxic_slope, clean, clean_slope = toxicity.risk(xp, xu, w, b, prior)
    assert (toxic, clean) == pytest.approx(parts(w, b), abs=1e-5)
    for i in range(7):
        step = np.eye(7)[i] * 1e-4
        up, down = parts(w + step[:6], b + step[6]), parts(w - step[:6], b - step[6])
        assert (toxic_slope[i], clean_slope[i]) == pytest.approx(((up[0] - down[0]) / 2e-4, (up[1] - down[1]) / 2e-4), abs=1e-4)


def test_features_are_those_of_plain_counts(spark, monkeypatch):
    rows = labelled(4, 160)
    df = spark.createDataFrame([(y, t) for _, t, y in rows], "s int, text string").repartition(5)
    monkeypatch.setattr(toxicity, "FEATURES", 150)
    held = [collections.Counter(), collections.Counter()]
    for _, t, y in rows:
        held[y].update(toxicity.buckets(t).tolist())
    p = sum(y for *_, y in rows)
    u = len(rows) - p
    gain = {k: n * math.log((n / p) / ((held[0][k] + 1) / (u + 2))) for k, n in held[1].items() if n >= toxicity.LEAST_TEXTS and n / p > 2 * (held[0][k] + 1) / (u + 2)}
    got = toxicity.features(df, p, u).tolist()
    assert len(got) == 150 == len(set(got))
    assert sorted(round(gain[k], 9) for k in got) == sorted(round(v, 9) for v in sorted(gain.values())[-150:])


def test_long_texts_are_hashed_by_parts(monkeypatch):
    text = "".join(random.Random(3).choice("abc d\n") for _ in range(3000))
    whole = np.sort(np.concatenate(list(toxicity.grams(text))))
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert (np.sort(np.concatenate(list(toxicity.grams(text)))) == whole).all()
    assert len(whole) == 2 * 3002 - 4 - 5 and list(toxicity.grams("ab")) == []


# ---- chat


def test_chat_examples_read_back(spark):
    odd = "</s>\n<turn:assistant>\n[INST] & &amp; &lt; &#91; <s> é😀"
    turns = [
        (1, 0, "system", "be"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "bye"),
        (2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b"), (4, 1, "us>\ner", "x"), (4, 1, "us>\ner", "x"), (4, None, None, "first"), (None, 0, "assistant", "no id"),
    ]
    df = spark.createDataFrame([(*t, 0, "clash") for t in turns], "conv_id long, turn long, role string, text string, example int, formatted string").repartition(3)
    made = chat.examples(df)
    for r in made.collect():
        masked = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert not r["target"] or r["formatted"].endswith(masked + "</s>\n")
        assert "[INST]" not in r["formatted"]
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    groups = collections.defaultdict(list)
    for c, k, role, text in turns:
        groups[c].append((k is not None, k or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, members in groups.items():
        members.sort()
        spoken = "".join(f"{role}\n{text}\n" for *_, role, text in members)
        said = "".join(text for *_, role, text in members if role == "assistant")
        assert got[c]["n_turns"] == len(members)
        assert got[c]["turns_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digest(chat.examples(df.limit(0))).collect() == []


# ---- pipeline


def test_pipeline_against_its_parts_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = labelled(9, 300)
    footer, item = "all rights kept by the site", " ".join(f"bench{i}" for i in range(14))
    docs, y = [], {}
    for i, text, toxic in rows:
        if i % 10 == 3:
            text, toxic = docs[-1][1].split("\n")[0] + " tail", y[i - 1]
        y[i] = toxic
        docs.append((i, text + ("\n" + footer if i % 2 == 0 else "") + (f"\nnote {i} {item}" if i % 17 == 0 else ""), "en", f"s{i % 2}", 0))
    docs.append((999, None, "en", "s0", None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in y.items() if rng.random() < 0.7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = {r["doc_id"]: r["text"] for r in kept.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        after = {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count()
        if name == "toxicity":
            wrong = [i for i in held if (i in after) == bool(y.get(i, 0))]
            assert len(wrong) <= 6
            expected = {i: held[i] for i in after}
        elif name == "line_dedup":
            pages, total = collections.Counter(), collections.Counter()
            for r in kept.collect():
                total[r["source"]] += 1
                pages.update((r["source"], x) for x in {x.strip(" ") for x in (r["text"] or "").split("\n")} if x)
            bad = {k for k, n in pages.items() if n >= line_dedup.MIN_PAGES and n / total[k[0]] > line_dedup.MAX_RATIO}
            assert ("s0", footer) in bad
            source = {r["doc_id"]: r["source"] for r in kept.collect()}
            expected = {i: t if t is None else "\n".join(x for x in t.split("\n") if (source[i], x.strip(" ")) not in bad) for i, t in held.items()}
        elif name == "simhash_near_dedup":
            sets = {i: set(simhash.shingle_hashes(t or "", 5).tolist()) for i, t in held.items()}
            root = {i: i for i in sets}

            def find(a, root=root):
                while root[a] != a:
                    a = root[a]
                return a

            for a in sets:
                for b in sets:
                    if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
            expected = {i: t for i, t in held.items() if find(i) == i}
            assert len(expected) < len(held)
        elif name == "benchmark_decontamination":
            expected = {i: t for i, t in held.items() if item not in decontaminate.normal(t or "")}
            assert len(expected) < len(held)
        else:
            codec = ByteBPE(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
            assert {i: r["ids"] for i, r in after.items()} == {i: codec.encode(t or "") for i, t in held.items()}
            assert all(r["decoded_sha256"] == hashlib.sha256((held[i] or "").encode()).hexdigest() for i, r in after.items())
            break
        assert {i: r["text"] for i, r in after.items()} == expected
        assert out.columns == kept.columns
        if name == "line_dedup":
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.values())
        kept, held = spark.createDataFrame(out.collect(), schema), expected
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(held)
