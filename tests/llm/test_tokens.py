"""op1 and op8: ids as the tokenizers library gives them, files that give single tokens, exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmart.llm import bpe, token_store
from quillmart.llm.common import TwoAgeCache, fresh_path

PIECES = [
    " ", "\n", "\t", "  ", "\r", "\x1c", "\x85", "\xa0", "　", ".", ",", ". ", ", ", "a", "The", "É", "é", "ß", "1", "22", "²", "½", "٣", "字", "!", "...", "'s", "'LL",
    "<|endoftext|>", "<|startoftext|>", "</w>", "<|", "😀", "́", "Σ", "ΑΣ", "İ", "\x00", "한", "ﬁ",
]
SCHEMA = "doc_id long, text string, id string, ids string, part int"


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def rows(values):
    return [(i, t, "x", "y", 7) for i, t in enumerate(values)]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_byte_ids_and_decoding_match_the_library(byte_level):
    codec = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"), memo=9000)
    for t in texts(4000, 1):
        ids = byte_level.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == byte_level.decode(ids, skip_special_tokens=False)
    assert codec.decode([codec.byte_id[0xE9]]) == "�"
    long = "ab" * 50_000
    assert codec.encode(long) == byte_level.encode(long, add_special_tokens=False).ids


def test_word_ids_match_the_library(word_level):
    encoder = token_store.WordIds(public_tokenizers.path("word_bpe_49k.json"), memo=9000)
    for t in texts(4000, 2):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == word_level.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**32 - 1] * 500, list(range(3000))])
def test_segments_give_single_ids_and_all_ids(values):
    segment = token_store.DacSegment(token_store.dac_pack(np.array(values, np.uint32)))
    assert segment.all().tolist() == values
    assert [segment[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        segment[len(values)]
    with pytest.raises(ValueError):
        token_store.DacSegment(b"????")


def test_store_round_trip_with_nulls_repeats_and_long_texts(spark, word_level):
    values = [*texts(40, 3), None, "", "word " * 3000, "same", "same"]
    docs = spark.createDataFrame(rows(values) + [(3, "again", "x", "y", 7), (None, "no id", "x", "y", 7)], SCHEMA).repartition(3)
    path = fresh_path(spark, "test-tokens")
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), segment_tokens=500)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(values) + 2
    start = 0
    by_text = {}
    for r in docs.collect():
        ids = [*word_level.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        by_text.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    last = None
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in by_text[r["doc_id"]]
        assert last is None or r["doc_id"] >= last
        last = r["doc_id"] if r["doc_id"] is not None else last


def test_single_tokens_of_a_store(spark, word_level, monkeypatch):
    values = [*texts(60, 5), "word " * 900, None, "tail"]
    docs = spark.createDataFrame(rows(values), SCHEMA).repartition(4)
    path = fresh_path(spark, "test-tokens")
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), segment_tokens=64)
    every = [i for t in values for i in [*word_level.encode(t or "", add_special_tokens=False).ids, 1]]
    asked = [*range(len(every)), 0, 0, -1, len(every), None]
    expected = sorted(((p, every[p] if p is not None and 0 <= p < len(every) else None) for p in asked), key=str)
    for named in (0, 10_000):
        monkeypatch.setattr(token_store, "NAMED_SEGMENTS", named)
        got = token_store.token_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long"), segment_tokens=64)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    for r in token_store.read_store(spark, path).collect():
        assert r["middle_id"] == every[r["start"] + r["n_tokens"] // 2]
    nothing = fresh_path(spark, "test-tokens")
    token_store.write_store(docs.limit(0), nothing, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_store(spark, nothing).count() == 0


def test_memo_is_bounded_by_bytes():
    memo = TwoAgeCache(lambda k: k.encode(), 30_000)
    for i in range(2000):
        assert memo[f"w{i % 900}"] == f"w{i % 900}".encode()
    assert memo["x" * 5000] == b"x" * 5000 and "x" * 5000 not in memo
    assert len(memo) + len(memo.old) <= 2 * 30_000 // TwoAgeCache.ENTRY + 2


def test_token_digests_and_extra_columns(spark, byte_level):
    values = [*texts(30, 4), None, ""]
    docs = spark.createDataFrame(rows(values) + [(0, values[0], "x", "y", 7)], SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.tokenized(docs, path, extra="ids").collect()
    assert len(got) == len(values) + 1
    for r in got:
        ids = byte_level.encode(values[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(byte_level.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.tokenized(docs, path, extra="decoded").collect()}
    assert decoded == {i: t or "" for i, t in enumerate(values)}
    assert bpe.tokenized(docs.limit(0), path).collect() == []
