"""Token-ID files of directly addressable codes: any token is found without decoding its neighbours.

An id is split into chunks of eight bits, least significant first. Level 0 holds the first chunk of every id, level 1
the second chunk of those ids that have one, and so on. Each level has a bitmap that says which of its chunks continue
on the next level and a rank directory: the number of set bits before every 512th position. Token ``i`` is level 0's
chunk ``i``; if its bit is set, its next chunk is at ``rank(i)`` on level 1.

Layout of a segment, all integers little-endian and unsigned: ``DAC1``, u32 levels, u64 ids; then for each level u64
chunks, the chunks, the bitmap (bit 0 first), and the directory as u32.

A store is a folder of Parquet rows, one for a segment of whole documents in ascending id order: ``part`` and ``seg``
(their order), ``part_offset`` (ids of the part before the segment), ``doc_ids``, ``n_tokens``, and ``codes``, the
segment's bytes. The files are not compressed and every row is a page of its own, so Spark's column index leads to a
segment's page, and :func:`token_at` reads that page alone and takes single tokens out of it. Spark's committer writes
them, so a retried task can't leave half a file.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmart.llm.bpe import printable_bytes
from quillmart.llm.common import TwoAgeCache, arrow_batches

#: Ids after which a segment is closed; a document is never divided, so a longer one makes a longer segment.
SEGMENT_TOKENS = 1 << 16
#: Segments that :func:`token_at` names in a filter, which Spark pushes down to the pages; more are joined.
NAMED_SEGMENTS = 200
#: Options of Parquet's writer for uncompressed pages of one row.
PAGES = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
#: Positions between two entries of a rank directory.
BLOCK = 512
#: Bytes of the young age of a worker's memo of space-delimited words.
MEMO_BYTES = 48 << 20
#: Fixed value: the pattern by which the word vocabulary's file cuts normalised text.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_pack(ids: np.ndarray) -> bytes:
    """The segment of ``ids`` (unsigned 32-bit)."""
    rest, levels = np.ascontiguousarray(ids, dtype=np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
        directory = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    return b"DAC1" + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class DacSegment:
    """Reads a segment: ``seg[i]`` alone, or ``seg.all()``."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", data, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            directory = np.frombuffer(data, "<u4", -(-n // BLOCK), at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += 8 + n + len(bitmap) + 4 * len(directory)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            whole = _POPCOUNT[bitmap[block * BLOCK // 8 : i >> 3]].sum()
            i = int(directory[block]) + int(whole) + int(_POPCOUNT[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        rest = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
            value[more] |= rest << np.uint32(8)
            rest = value
        return rest


class _Joined(Exception):
    """A word that ends in a mark, to which the mark split off behind it belongs."""


class WordIds:
    """Ids of texts by the tokenizers library, whose model gets each distinct word once as long as a worker's memo has it.

    The vocabulary's file lowers letters, drops white space and never joins across it, nor across a letter and a mark,
    so the ids of a text are those of its words. Texts that hold the string of an added token go to the library whole.
    """

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize, self.shown = self.tokenizer.model.tokenize, printable_bytes()
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(WORDS).findall
        self.by_word = TwoAgeCache(self._word, memo)
        self.by_unit = TwoAgeCache(self._unit, memo // 6)

    def _unit(self, unit: str) -> bytes:
        words = (unit,) if unit.isalpha() else self.cut(unit)
        shown = (w if w.isascii() and w.isprintable() else "".join(map(self.shown.__getitem__, w.encode())) for w in words)
        return array("I", [k.id for w in shown for k in self.tokenize(w)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word and not word[-1].isalnum() and word not in (".", ","):
            raise _Joined
        return self._unit(word)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if any(m in text for m in self.marks):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Capital sigma is lowered by itself, as the library does, not by its place in the word.
        text = text.replace("Σ", "σ").lower().replace("\n", " ") + " "
        # A full stop or comma before white space is cut off as a word of its own, so there are fewer different
        # words, unless it stands next to another mark, with which it forms one word.
        if not (".," in text or ",." in text or ".." in text or ",," in text):
            try:
                return b"".join(map(self.by_word.__getitem__, text.replace(". ", " . ").replace(", ", " , ").split(" ")))
            except _Joined:
                pass
        return b"".join(map(self.by_unit.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder for a vocabulary file in each worker."""
    return WordIds(path)


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Encode every whole text, append ``end_id`` to each document and write a store at ``path``.

    Documents are dealt by ranges of their id (and of a hash of their text, so that the rows of a repeated id can be
    divided) and sorted within, so part, segment and place give ascending id order. Ids are integers. A null text counts
    as empty (only the end id); rows with a null id come first; repeated ids all stay, ordered by that hash, then by
    text. One task holds a batch of texts and one segment at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        part, seg, offset = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            counts = [len(x) // 4 for x in ids]
            row = [[part], [seg], [offset], [keys], [counts], [sum(counts)], [dac_pack(np.frombuffer(b"".join(ids), "<u4"))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seg", "part_offset", "doc_ids", "n_tokens", "seg_tokens", "codes"])

        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), map(encoder.encode, b.column(1).to_pylist())):
                keys.append(key)
                ids.append(x + end)
                held += len(ids[-1]) // 4
                if held >= segment_tokens:
                    yield segment()
                    seg, offset, held = seg + 1, offset + held, 0
                    keys, ids = [], []
        if keys:
            yield segment()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    schema = "part int, seg int, part_offset long, doc_ids array<long>, n_tokens array<long>, seg_tokens long, codes binary"
    ordered.mapInArrow(run, schema).write.options(**PAGES).parquet(path)


def _bases(store: DataFrame) -> DataFrame:
    """``(part, base)``: the ids before a part, a running sum over one row a part, as many as there were tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("seg_tokens").alias("n"))
    return F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``middle_id``.

    ``middle_id`` is the document's id at place ``n_tokens / 2`` (rounded down), taken by itself out of the codes. What
    stands before a segment in its part is in the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, offset, keys, counts, codes in zip(*(b.column(c).to_pylist() for c in ("part", "part_offset", "doc_ids", "n_tokens", "codes"))):
                segment = DacSegment(codes)
                ends = np.cumsum(np.array(counts, np.int64))
                starts = ends - np.array(counts, np.int64)
                data = segment.all().astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                middle = [segment[a + n // 2] for a, n in zip(starts.tolist(), counts)]
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts + offset), *(pa.array(x, pa.int64()) for x in (counts, crc, middle))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "within", "n_tokens", "ids_crc32", "middle_id"])

    arrow_batches(spark)
    store = spark.read.parquet(path)
    rows = store.mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids_crc32 long, middle_id long")
    return rows.join(_bases(store), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "middle_id")


def token_at(spark: SparkSession, path: str, positions: DataFrame, col: str = "position", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """``(position, token_id)``: the ids at places of the whole store, each taken by itself out of its segment's codes.

    Every row of ``positions`` has a row, repeated ones and nulls too; ``token_id`` is null beyond the store's ends.
    The directory of segments is joined by stretches of ``segment_tokens`` places. Up to NAMED_SEGMENTS segments are
    named in a filter on the store, so only their pages are read; the codes of more are joined to the places asked.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, asked, codes in zip(*(b.column(c).to_pylist() for c in ("start", "asked", "codes"))):
                segment = DacSegment(codes)
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([segment[p - start] for p in asked], pa.int64())], ["at", "token_id"])

    arrow_batches(spark)
    store = spark.read.parquet(path)
    wanted = positions.select(F.col(col).cast("long").alias("at")).where(F.col("at").isNotNull()).distinct()
    directory = store.select("part", "seg", "part_offset", "seg_tokens").join(_bases(store), "part")
    directory = directory.select("part", "seg", (F.col("base") + F.col("part_offset")).alias("start"), "seg_tokens")
    first, last = F.floor(F.col("start") / segment_tokens), F.floor((F.col("start") + F.col("seg_tokens") - 1) / segment_tokens)
    stretches = directory.withColumn("stretch", F.explode(F.sequence(first, last)))
    met = wanted.withColumn("stretch", F.floor(F.col("at") / segment_tokens)).join(stretches, "stretch")
    met = met.where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("seg_tokens")))
    asked = met.groupBy("part", "seg", "start").agg(F.collect_list("at").alias("asked"))
    names = asked.select("part", "seg").limit(NAMED_SEGMENTS + 1).collect()
    if len(names) <= NAMED_SEGMENTS:
        store = store.where(reduce(or_, ((F.col("part") == n["part"]) & (F.col("seg") == n["seg"]) for n in names), F.lit(False)))
    found = store.select("part", "seg", "codes").join(asked, ["part", "seg"]).select("start", "asked", "codes").mapInArrow(look, "at long, token_id long")
    return positions.select(F.col(col).cast("long").alias("position")).join(found, F.col("position") == F.col("at"), "left").select("position", "token_id")
