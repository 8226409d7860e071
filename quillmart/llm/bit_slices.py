"""Bit-sliced Hamming comparison: codes stand in vertical bit planes, and carry-save counters add up many distances at once.

Rows are dealt into blocks; rows of one block are compared with each other. A task holds rows sorted by block. Plane
``p`` has bit ``p`` of 64 rows in each word, so one exclusive-or of a plane with itself, shifted by ``s`` places,
compares 64 rows with the rows ``s`` places behind them. Bitwise counters (two planes a step) add these up to 64
distances a word. A word is abandoned once each of its 64 rows is beyond the radius or has no partner at that shift.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import dealt, written
from quillmart.llm.components import splittable

#: Rows of a tile. Blocks with more are cut into tiles, and each pair of tiles is compared in a place of its own.
TILE = 256
#: Rows that a task gathers before it compares them.
CHUNK = 16_384
#: Bytes that a task gathers at most beyond one place, where rows carry sets.
CHUNK_BYTES = 64 << 20
#: Planes that are added up before words are abandoned.
PLANES = 16


def planes_of(codes: np.ndarray) -> np.ndarray:
    """Bit planes of ``(rows, words)`` unsigned 64-bit codes, each padded by a word of zeros."""
    rows = len(codes)
    width = -(-rows // 64) + 1
    bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(rows, -1), axis=1, bitorder="little")
    tall = np.zeros((bits.shape[1], width * 64), np.uint8)
    tall[:, :rows] = bits.T
    return np.packbits(tall, axis=1, bitorder="little").view("<u8")


def _lanes(flags: np.ndarray, width: int) -> np.ndarray:
    padded = np.zeros(width * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``; the last counter says that the others have overflown."""
    over = np.zeros_like(counters[0])
    equal = ~over
    for i in range(len(counters) - 2, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            over |= equal & counters[i]
            equal &= ~counters[i]
    return over | counters[-1]


def close_pairs(codes: np.ndarray, block: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance)`` of all rows of one block at most ``radius`` apart, for rows sorted by block.

    ``tile`` is 0 or 1 for rows of a pair of two tiles, of which only unlike rows are compared, and -1 in other blocks.
    """
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    planes = planes_of(codes)
    width, digits = planes.shape[1], radius.bit_length()
    for s in range(1, len(block)):
        same = block[:-s] == block[s:]
        if not same.any():
            break
        words = np.flatnonzero(alive := _lanes(same & ((tile[:-s] < 0) | (tile[:-s] != tile[s:])), width))
        alive = alive[words]
        counters = [np.zeros(len(words), np.uint64) for _ in range(digits + 1)]
        skip, turn = s // 64, np.uint64(s % 64)
        for p in range(0, len(planes), PLANES):
            if not len(words):
                break
            near = planes[p : p + PLANES, words]
            far = planes[p : p + PLANES, np.minimum(words + skip, width - 1)]
            if turn:
                far = (far >> turn) | (planes[p : p + PLANES, np.minimum(words + skip + 1, width - 1)] << (np.uint64(64) - turn))
            near ^= far
            for q in range(0, len(near) - 1, 2):
                _add_two(counters, near[q], near[q + 1])
            if len(near) % 2:
                _add_two(counters, near[-1], np.zeros_like(near[-1]))
            alive &= ~_beyond(counters, radius)
            stay = alive != 0
            if not stay.all():
                words, alive, counters = words[stay], alive[stay], [c[stay] for c in counters]
        if len(words):
            lanes = np.unpackbits(alive.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            distance = np.zeros(len(at), np.int64)
            for i, c in enumerate(counters[:-1]):
                distance |= (c[at] >> lane.astype(np.uint64) & np.uint64(1)).astype(np.int64) << i
            first = words[at] * 64 + lane
            out.append((first, first + s, distance))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _add_two(counters: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
    """Add two bits to each lane's count: a full adder for the lowest counter, half adders above it."""
    low = counters[0] ^ x
    carry = counters[0] & x | low & y
    counters[0] = low ^ y
    for i in range(1, len(counters) - 1):
        counters[i], carry = counters[i] ^ carry, counters[i] & carry
    counters[-1] |= carry


def forest(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> list[int]:
    """Places of the links of a spanning forest with the least distances (Kruskal)."""
    root = list(range(n))
    taken: list[int] = []
    for k in np.lexsort((j, i, distance)).tolist():
        a, b = int(i[k]), int(j[k])
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            taken.append(k)
    return taken


def shared_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` of the blocks that have more than one, with their number ``n_rows``."""
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    return rows.join(dealt(splittable(counts, "block")), "block")


def _in_places(rows: DataFrame, tile: int | None = None) -> DataFrame:
    """Rows ``(block, node, ...)`` dealt to places, a tile or a pair of tiles of a block each: ``place``, ``low``, ``high`` and ``tile`` are added.

    ``rows`` of :func:`shared_blocks` have their ``n_rows`` and keep no others.
    """
    rows = rows if "n_rows" in rows.columns else shared_blocks(rows)
    tile, kept = tile or TILE, [c for c in rows.columns if c not in ("block", "n_rows")]
    tiles = F.ceil(F.col("n_rows") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    dealt = rows.select("block", *kept, tiles.alias("tiles"), own.alias("own"))
    # A row of a block of several tiles goes to each pair of tiles that its own is part of.
    dealt = dealt.select("block", *kept, "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tile_of = F.when(low == high, -1).otherwise(F.when(F.col("own") == low, 0).otherwise(1)).cast("int")
    return dealt.select(F.xxhash64("block", low, high).alias("place"), "block", low.alias("low"), high.alias("high"), *kept, tile_of.alias("tile"))


def _by_place(placed: DataFrame, found: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``found(rows, number of each row's place)`` of whole places, some of them at a time."""
    ordered = placed.repartition("place").sortWithinPartitions("place", "block", "low", "high")

    def compare(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """Compare all whole places of what is held; the rest waits for more rows."""
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(c).to_numpy() for c in ("place", "block", "low", "high")])
        fresh = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        end = t.num_rows if last else int(np.flatnonzero(fresh)[-1])
        rest = t.slice(end).to_batches()
        return (found(t.slice(0, end).combine_chunks(), np.cumsum(fresh[:end])) if end else None), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK or sum(x.nbytes for x in held) >= CHUNK_BYTES:
                out, held = compare(held, False)
                if out is not None:
                    yield out
        if held:
            out, _ = compare(held, True)
            if out is not None:
                yield out

    return ordered.mapInArrow(run, schema)


def _codes(t: pa.Table) -> np.ndarray:
    return t.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)


def links_in_blocks(rows: DataFrame, radius: int, tile: int | None = None) -> DataFrame:
    """``(a, b, distance)``: links of rows that share a block and are at most ``radius`` apart.

    ``rows`` has ``block long, node long, code array<long>``, or ``n_rows`` too. In each tile or pair of tiles the links are a spanning
    forest of least distances: no pair within the radius ends up in different components, and a group of copies gives
    about as many links as rows, not all its pairs. Where a link still has to pass another test, :func:`open_rows` and
    :func:`proven_links` find what the forest left out.
    """

    def found(t: pa.Table, place: np.ndarray) -> pa.RecordBatch | None:
        node = t.column("node").to_numpy()
        i, j, d = close_pairs(_codes(t), place, t.column("tile").to_numpy(), radius)
        if not len(i):
            return None
        k = forest(len(node), i, j, d)
        return pa.RecordBatch.from_arrays([pa.array(node[i[k]]), pa.array(node[j[k]]), pa.array(d[k].astype(np.int32))], ["a", "b", "distance"])

    placed = _in_places(rows, tile)
    return written(_by_place(placed, found, "a long, b long, distance int"), "block-links")


def open_rows(rows: DataFrame, radius: int, few: int, tile: int | None = None) -> DataFrame:
    """``(place, block, low, high, node, root, tile)`` of rows with a partner of another root in their place.

    ``rows`` has ``block, node, root, size`` as longs, ``n_rows`` or not, and ``code array<long>``. Partners are at most ``radius`` apart or
    both of at most ``few`` elements; sets that small have fingerprints too uncertain for a radius.
    """

    def found(t: pa.Table, place: np.ndarray) -> pa.RecordBatch | None:
        root, tiles, size = (t.column(c).to_numpy() for c in ("root", "tile", "size"))
        i, j, _ = close_pairs(_codes(t), place, tiles, radius)
        meets = np.zeros(len(root), bool)
        apart = root[i] != root[j]
        meets[i[apart]] = meets[j[apart]] = True
        small = np.flatnonzero(size <= few)
        if len(small):
            _, at = np.unique(place[small], return_inverse=True)
            least, most = np.full(at.max() + 1, np.iinfo(np.int64).max), np.full(at.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(least, at, root[small])
            np.maximum.at(most, at, root[small])
            meets[small[least[at] != most[at]]] = True
        columns = ["place", "block", "low", "high", "node", "root", "tile"]
        return t.select(columns).filter(pa.array(meets)).combine_chunks().to_batches()[0] if meets.any() else None

    return _by_place(_in_places(rows, tile), found, "place long, block long, low int, high int, node long, root long, tile int")


def proven_pairs(sets: list[np.ndarray], root: np.ndarray, tile: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of one place with a Jaccard similarity of at least ``similarity`` that join all roots such pairs join.

    Every pair is tested whose rows aren't joined yet; ``sets`` have no repeats.
    """
    size = np.array([len(x) for x in sets])
    _, name = np.unique(root, return_inverse=True)
    values, element = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    element = [element[a:z] for a, z in zip(starts, starts[1:])]
    mark = np.zeros(len(values), bool)
    out: list[tuple[int, int]] = []
    for i in range(len(sets) - 1):
        mark[element[i]] = True
        less, more = np.minimum(size[i], size), np.maximum(size[i], size)
        possible = (name != name[i]) & (less >= similarity * more) & ((tile < 0) | (tile != tile[i]))
        for j in (np.flatnonzero(possible[i + 1 :]) + i + 1).tolist():
            if name[j] == name[i]:
                continue
            common = np.count_nonzero(mark[element[j]])
            if common >= similarity * (size[i] + size[j] - common):
                name[name == name[j]] = name[i]
                out.append((i, j))
        mark[element[i]] = False
    return out


def proven_links(rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of :func:`proven_pairs` in each place of :func:`open_rows` with ``elements binary``, the 64-bit elements of each row's set."""

    def found(t: pa.Table, place: np.ndarray) -> pa.RecordBatch | None:
        node, root, tile = (t.column(c).to_numpy() for c in ("node", "root", "tile"))
        elements = t.column("elements")
        a, b = [], []
        cuts = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(place)]
        for x, z in zip(cuts, cuts[1:]):
            sets = [np.frombuffer(e.as_buffer(), np.uint64) for e in elements.slice(x, z - x)]
            for i, j in proven_pairs(sets, root[x:z], tile[x:z], similarity):
                a.append(node[x + i])
                b.append(node[x + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    return _by_place(rows, found, "a long, b long")
