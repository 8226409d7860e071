"""op11 to op13 against brute force, round trips and held-out rows, on small documents with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmart.llm import fim, periodic_runs, quality, queries

ODD = [(None, "a null id"), (7, None), (8, ""), (9, "été 😀 naïve\x00\n\tß" * 30), (10, "<P> marks <M>"), (3, "twice"), (3, "twice"), (3, "twice, other text")]


def frame(spark, rows):
    """Documents with columns of names that the operators use inside."""
    clash = "doc_id long, text string, id string, n string, form string, runs string, rank_index string, good string, quality_score string, h string"
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], clash).repartition(3)


# ---- fill in the middle


def test_an_index_gives_every_boundary():
    rng = random.Random(1)
    texts = ["", "a", "ab", " ", "a b", "Zz@[`{", "é" * 500, "word " * 5000 + "x" * 100_000 + " y" * 5000, "".join(rng.choice("ab .é") for _ in range(3000))]
    for text in texts:
        cut = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        want = np.cumsum([0, *map(len, cut)])
        assert fim.boundaries(text).tolist() == want.tolist()
        for error in (0, 3, fim.ERROR):
            index = fim.RankIndex.from_bytes(fim.RankIndex.fit(want, error).to_bytes())
            assert [index[k] for k in range(len(index))] == want.tolist()
            assert np.abs(index.residuals.astype(int)).max() <= error + 1
    assert len(fim.RankIndex.fit(np.arange(0, 10**6, 5)).first) == 1
    with pytest.raises(IndexError):
        index[len(index)]


@given(st.lists(st.integers(0, 400), max_size=300), st.integers(0, fim.ERROR))
@settings(max_examples=60, deadline=None)
def test_segments_are_as_long_as_they_can_be(steps, error):
    offsets = np.cumsum([0, *steps])
    index = fim.RankIndex.fit(offsets, error)
    assert [index[k] for k in range(len(index))] == offsets.tolist()
    for i, z in zip(index.ranks, [*index.ranks[1:], None]):
        if z is not None:  # no slope serves the next boundary too
            x, y = np.arange(1, z - i + 1), offsets[i + 1 : z + 1] - offsets[i]
            assert max(0, ((y - error) / x).max()) > ((y + error) / x).min()


def by_hand(key, text, seed=1):
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, len(w), "plain", None, None, text
    a, z = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return key, len(w), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_examples_are_those_by_hand_and_give_the_text_back(spark):
    rng = random.Random(2)
    rows = ODD + [(100 + i, "".join(rng.choice("abé <>P\n.") for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(999, "long " * 200_000)]
    docs = frame(spark, rows)
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    got = Counter(tuple(r[c] for c in columns) for r in fim.examples(docs).collect())
    assert got == Counter(by_hand(*r) for r in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    stored = fim.with_index(docs)
    assert stored.count() == len(rows) and set(docs.columns) == set(stored.columns)
    other = Counter(tuple(r[c] for c in columns) for r in fim.examples(stored, seed=2, index_col="rank_index").collect())
    assert other == Counter(by_hand(*r, seed=2) for r in rows)
    back = Counter((r["doc_id"], r["restored_sha256"]) for r in fim.digest(fim.examples(docs)).collect())
    assert back == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert fim.examples(docs.limit(0)).collect() == []


def test_examples_equal_their_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rows = con.execute(queries.ORACLE_SQL["op11_fill_in_middle"])
    names = [c[0] for c in rows.description]
    want = Counter(rows.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in queries.op11_fill_in_middle(spark, d).collect()) == want


# ---- periodic runs


def all_runs(ids, least, exponent):
    n, found = len(ids), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if (length := j - i + q) >= max(least, exponent * q) and not any(all(ids[t] == ids[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_text(rng):
    """Words with planted loops, loops in loops, overlapping and touching runs."""
    words = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(0, 4)):
        period = [rng.choice("ab" if rng.random() < 0.4 else "abcdef") for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 16, 17, 18, 33, 40)))]
        if rng.random() < 0.3:
            period = period * rng.randint(2, 4) + [rng.choice("abz")]
        loop = (period * 9)[: rng.randint(1, min(6 * len(period), 260))]
        words += loop + [rng.choice("abcdefg") for _ in range(rng.randint(0, 5))]
    return words


@pytest.mark.parametrize("least, exponent", [(24, 3), (1, 3), (6, 3), (24, 5)])
def test_runs_are_those_of_all_periods(least, exponent):
    rng = random.Random(least * 10 + exponent)
    several = 0
    for _ in range(120):
        words = word_text(rng)
        ids = periodic_runs.numbered([w.encode() for w in words])
        want = all_runs(ids.tolist(), least, exponent)
        assert periodic_runs.find_runs(ids, least, exponent) == want
        several += len(want) > 1
    assert several > 2
    with pytest.raises(ValueError):
        periodic_runs.find_runs(ids, 24, 2)


def collapsed_by_hand(key, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left))
    return key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests


def test_collapsed_texts_are_those_by_hand(spark):
    rng = random.Random(5)
    rows = ODD + [(100 + i, "  " + rng.choice(" \t\n\x0b").join(word_text(rng)) + "\x1c x\u0085") for i in range(200)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 10
    docs = frame(spark, rows)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = Counter(tuple(r[c] for c in names) for r in periodic_runs.digest(periodic_runs.collapse(docs, loops=True)).collect())
    assert got == Counter(collapsed_by_hand(*r) for r in rows)
    assert periodic_runs.digest(periodic_runs.collapse(docs.limit(0))).collect() == []


def test_one_word_many_times_is_one_run(spark):
    text = "spam " * 300_000 + "ham"
    row = periodic_runs.collapse(frame(spark, [(1, text)])).first()
    assert (row["n_words"], row["collapsed"]) == (300_001, "spam ham")
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 1)]


# ---- quality


def rated(seed, n=700):
    """Good prose of made-up words, bad texts of three kinds, and labels for two thirds."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice(["an", "er", "th", "ing", "o", "el", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, truth = [], {}
    for i in range(n):
        words = [rng.choice(lexicon) for _ in range(rng.randint(20, 300))]
        truth[i] = int(rng.random() < 0.8)
        if not truth[i]:
            kind = rng.randrange(3)
            words = [w + "$$$" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else ["|".join(words[:9])] * len(words)
        docs.append((i, " ".join(words)))
    return docs, truth


def test_quality_separates_held_out_rows(spark):
    docs, truth = rated(6)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]

    def labels(flip=()):
        known = [(i, 1 - q if i in flip else q) for i, q in truth.items() if i % 3]
        return spark.createDataFrame(known + [(None, 1), (5, None), (10_000, 0), known[0]], "doc_id long, quality int")

    rows = frame(spark, docs + ODD + [(20_000, docs[0][1] * 500)])
    model = quality.train(rows.drop("good"), labels())
    scored = quality.score(rows, model).collect()
    assert len(scored) == len(docs) + len(ODD) + 1 and set(scored[0].asDict()) == set(rows.columns)
    by_id = {r["doc_id"]: r["quality_score"] for r in scored}
    assert all(0 <= s <= 1 for s in by_id.values())
    right = sum((by_id[i] >= quality.THRESHOLD) == truth[i] for i in held)
    assert right / len(held) > 0.97
    assert by_id[20_000] >= quality.THRESHOLD
    assert quality.train(rows, labels(flip=held)) == model  # labels of held-out rows change nothing


def test_quality_without_labels_or_of_one_class(spark):
    docs = frame(spark, rated(7, 30)[0])
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["quality_score"] for r in quality.score(docs, none).collect()} == {0.5}
    good = quality.train(docs, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int"))
    assert {round(r["quality_score"], 6) for r in quality.score(docs, good).collect()} == {round(1 - 1 / (2 + sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(30))), 6)}
    assert quality.score(docs.limit(0), good).collect() == []


def test_the_feature_is_the_difference_of_whole_sizes():
    docs, truth = rated(8, 200)
    good, bad = (quality.dictionary([p for i, t in docs if truth[i] == q for p in quality.parts(t)]) for q in (1, 0))
    sizes = quality.Sizes(good, bad)
    assert sizes.feature("") == 0
    for _, text in docs[:20]:
        long = text * 10
        size = {}
        for name, content in (("good", good), ("bad", bad)):
            import zstandard

            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False, write_checksum=False)
            data = long.encode()
            size[name] = sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))
        assert sizes.feature(long) == (size["bad"] - size["good"]) / (len(data) + 64)


def test_calibration_is_the_weighted_logistic_fit():
    rng = np.random.default_rng(9)
    y = (rng.random(4000) < 0.5).astype(int)
    x = rng.normal(np.where(y == 1, 0.1, -0.1), 0.1)
    slope, intercept = quality.calibrate(x, y, 0.9)
    assert abs(slope - 20) < 2 and abs(intercept - np.log(9)) < 0.3  # normal classes: slope (m1 - m0) / variance
    apart = quality.calibrate(np.array([-1.0, -1, 1, 1]), np.array([0, 0, 1, 1]), 0.5)
    assert np.isfinite(apart).all() and apart[0] > 0
