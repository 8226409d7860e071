"""SimHash near-duplicates: fingerprints of word shingles, compared by :mod:`bit_slices`.

Two forms. :func:`near_duplicates` links documents whose 64-bit fingerprints differ in at most ``radius`` bits, exactly:
the bits are cut into pieces, two fingerprints within the radius agree in some pieces, and every choice of that many
pieces makes blocks. :func:`similar_documents` links documents whose sets of shingles have a Jaccard similarity of at
least ``similarity``: blocks come from least shingle hashes, wide fingerprints choose links within blocks, and the
shingles of both texts verify each link. A chosen link that fails may have crowded out one that holds, so in a second
step every pair within the radius that verified links leave apart is tested in its block by its shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.bit_slices import links_in_blocks, open_rows, proven_links, shared_blocks
from quillmart.llm.common import dealt, discard, written
from quillmart.llm.components import components, splittable

SEED = 42
#: op10: words of a shingle, bits that may differ.
WORDS, RADIUS = 4, 4
#: Unrelated fingerprints that a block may hold on average, and pieces of a fingerprint at most (of 12 pieces, with a
#: radius of 4, there are 495 choices, whose blocks have 42 bits).
BLOCK_ROWS, MOST_PIECES = 8, 12
#: Near-duplicate stage: words of a shingle and least similarity.
STAGE_WORDS, SIMILARITY = 5, 0.8
#: Blocks of a document: BANDS choices of BAND_ROWS least hashes. At a similarity of 0.8 all bands miss with a
#: probability of (1 - 0.8 ** 2) ** 12, one in 200,000.
BANDS, BAND_ROWS = 12, 2
#: 64-bit words of a wide fingerprint; its radius is four standard deviations over the distance expected at SIMILARITY.
WIDE = 4
#: Texts of up to so many shingles are compared by their shingles alone: the distance expected holds for large sets
#: (4 of 5 shingles differ in 48 bits, not 39), and at odd sizes up to some dozens it is short by a bit or two.
FEW = 64
#: Ids that may be broadcast to the texts: 16 bytes each in a long's hash table, so 8 MB at most.
BROADCAST_IDS = 500_000
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included: A-Z lowered, words parted by ASCII white space, joined by blanks.

    A text of fewer words is one shingle, a text without words has none.
    """
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:z], SEED) for a, z in zip(starts, ends[words - 1 :] or ends[-1:])], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint words of ``(n, words)`` hashes: a bit is 1 if it is set in over half of them; zero without hashes."""
    counts = np.zeros(hashes.shape[1] * 64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK])
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of every document; a null text counts as empty, and the fingerprint of no words is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [majority(shingle_hashes(t, words)[:, None])[0] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, fp long")


def _piece_blocks(fp: Column, radius: int, pieces: int) -> Column:
    """A block for each choice of ``pieces - radius`` pieces: which pieces, and their bits."""
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")) for a, z in zip(cuts, cuts[1:])]
    return F.array(*(F.xxhash64(F.lit(n), *(part[i] for i in chosen)) for n, chosen in enumerate(combinations(range(pieces), pieces - radius))))


def pieces_for(rows: int, radius: int) -> int:
    """The fewest pieces whose blocks hold BLOCK_ROWS of ``rows`` unrelated fingerprints or fewer, so that what is compared grows with the rows."""
    fits = (n for n in range(radius + 2, MOST_PIECES) if rows <= BLOCK_ROWS << 64 * (n - radius) // n)
    return next(fits, max(MOST_PIECES, radius + 2))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, pieces: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` of every row: the least id that chains of fingerprints within ``radius`` bits reach.

    Equal fingerprints are compared once. Null ids take part but never name a component (one of null ids alone has a
    null component). ``pieces`` must exceed ``radius``; more pieces make smaller blocks and more of them, and without a
    number :func:`pieces_for` chooses by the count of fingerprints. Any number gives the same result.
    """
    marked = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    pieces = pieces or pieces_for(distinct.count(), radius)
    blocks = distinct.select(F.explode(_piece_blocks(F.col("fp"), radius, pieces)).alias("block"), F.col("fp").alias("node"), F.array("fp").alias("code"))
    roots = components(links_in_blocks(blocks, radius))
    rooted = distinct.join(dealt(roots), distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = splittable(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted different hashes of a text's shingles, cut as in :func:`shingle_hashes`: a polynomial of the XXH64 of each word."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(word))
    out = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        out *= _ODD[0]
        out += word[i : len(word) - n + 1 + i]
    return np.unique(out)


#: Odd multipliers, fixed by a seed: the first for :func:`shingle_set`, the others order shingles for the least hashes.
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 1 + BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray, rounds: int) -> np.ndarray:
    """``(n, rounds)`` further hashes of hashes."""
    x = h[:, None] + _MIX[0] * np.arange(1, rounds + 1, dtype=np.uint64)[None, :]
    x ^= x >> np.uint64(30)
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    return x ^ x >> np.uint64(31)


def sketch(text: str, words: int) -> tuple[bytes, int, list[int], list[int]]:
    """Digest of a text's set of shingles, its size, its wide fingerprint, and the hashes of its bands."""
    h = shingle_set(text, words)
    digest = xxhash.xxh3_128_digest(h.tobytes())
    fp = np.zeros(WIDE * 64, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        wide = _mixed(part, WIDE)
        fp += np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        least = np.minimum(least, (wide[:, :1] * _ODD[1:]).min(axis=0))
    bands = [xxhash.xxh64_intdigest(least[i : i + BAND_ROWS].tobytes(), i) for i in range(0, len(least), BAND_ROWS)]
    code = np.packbits(fp * 2 > len(h), bitorder="little").view("<u8")
    return digest, len(h), code.view(np.int64).tolist(), np.array(bands, np.uint64).view(np.int64).tolist()


def wide_radius(similarity: float) -> int:
    """Bits that fingerprints of two sets of this Jaccard similarity may differ in, with four standard deviations to spare."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return math.floor(bits * differ + 4 * math.sqrt(bits * differ * (1 - differ)))


def _links_left_out(texts: DataFrame, rows: DataFrame, proven: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of similar texts that share a block of ``rows`` and that the components ``proven (node, root)`` leave apart."""
    rooted = rows.join(dealt(proven), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A block whose rows are joined already has nothing left to find.
    apart = rooted.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high")).select("block")
    # A pair of which one has at most FEW shingles: the other may have more by the similarity.
    left = written(open_rows(rooted.join(splittable(apart, "block"), "block", "left_semi"), wide_radius(similarity), math.floor(FEW / similarity)), "open-rows")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            elements = [shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(elements, pa.binary())], ["node", "elements"])

    open_texts = texts.join(left.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    elements = written(open_texts.select("id", "text").mapInArrow(sets, "node long, elements binary"), "open-sets")
    found = written(proven_links(left.join(elements, "node"), similarity), "found-links")
    discard(left, elements)
    return found


def similar_documents(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, group_id)`` of every different id: the least id of its group of documents with similar shingles.

    Documents with equal sets of shingles (so all without words, and null texts) form a group at once. Between
    representatives, links chosen by fingerprints count if the Jaccard similarity of their shingles is at least
    ``similarity``. Null ids have no row; of repeated ids the first text in order counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids of documents must be integers")
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(t, words) for t in b.column(1).to_pylist()]
            digest, size, code, bands = (list(x) for x in zip(*made)) if made else ([], [], [], [])
            longs = pa.list_(pa.int64())
            columns = [b.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(code, longs), pa.array(bands, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "size", "code", "bands"])

    sketched = written(slim.mapInArrow(run, "id long, digest binary, size long, code array<long>, bands array<long>"), "sketches")
    first = sketched.groupBy("digest").agg(F.min(F.struct("id", "size", "code", "bands")).alias("r"))
    first = written(first.select("digest", F.col("r.id").alias("node"), "r.size", "r.code", "r.bands"), "representatives")
    copies = sketched.select("id", "digest").join(first.select("digest", "node"), "digest").select(F.col("id").alias("a"), F.col("node").alias("b"))
    copies = written(copies.where(F.col("a") != F.col("b")), "copies")
    every = written(sketched.select("id").distinct(), "ids")
    discard(sketched)
    # Codes follow once the blocks of one row are gone, which most are.
    blocks = first.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("block"), "node")
    rows = written(shared_blocks(blocks).join(first.select("node", "size", "code"), "node"), "block-rows")
    discard(first)
    chosen = links_in_blocks(rows.select("block", "node", "code", "n_rows"), wide_radius(similarity))
    links = chosen.select("a", "b").where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "chosen-links")
    discard(chosen)
    # Texts are needed of linked documents and of those of few shingles that share a block, here and in the second step.
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).unionByName(rows.where(F.col("size") <= FEW / similarity).select(F.col("node").alias("id")))
    ends = written(ends.distinct(), "linked-ids")
    # Few ids are sent to the texts; otherwise both are dealt by id.
    ends_near = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
    texts = slim.join(ends_near, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts = written(texts, "linked-texts")
    paired = links.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for left, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = shingle_set(left, words), shingle_set(right, words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    proven = components(paired.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long"))
    left_out = _links_left_out(texts, rows, proven, words, similarity)
    discard(links, ends, texts, rows)
    roots = components(proven.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(left_out).unionByName(copies))
    discard(left_out, copies)
    return every.join(roots, every["id"] == roots["node"], "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("group_id"))


def one_of_each_group(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the least id of their group, all columns kept. Rows with a null id stay; repeated ids stay or go together."""
    groups = similar_documents(docs, words, similarity, id_col, text_col)
    others = groups.where(F.col(id_col) != F.col("group_id")).select(id_col)
    return docs.join(others, id_col, "left_anti").select(*docs.columns)
