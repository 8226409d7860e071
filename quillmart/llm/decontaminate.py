"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``n`` characters may be told from a passage by ``k = floor(error_rate * n)`` edits. Cut into ``k + 1``
pieces, at least one piece of it stands in such a passage unchanged. One automaton finds all pieces in a text; each hit
says where its item would begin, and Myers' bit-parallel distance verifies the surroundings. Texts and items are
compared in lower case with white space collapsed. Items of fewer than ``MIN_CHARS`` characters are found only
unchanged, and not inside of words.

Items come in blocks of ``BLOCK_CHARS``; a block is what tasks are sent, so its size is bounded however large the
benchmark is, and each block takes one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmart.llm.common import discard, written

#: Share of an item's characters that may be edited.
ERROR_RATE = 0.07
#: Shorter items have no budget: they count where they stand unchanged, on word borders.
MIN_CHARS = 40
#: Characters of the items in a block.
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def on_word_borders(text: str, begin: int, end: int) -> bool:
    """Whether the passage neither begins nor ends inside of a word."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(begin) and not inside(end)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of about equal length, with their offsets; they cover the item."""
    n, k = len(item), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance of a pattern to any substring of a text; the pattern's bits stand in one Python integer."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """``(distance, end)`` of the first best substring; ``end`` is exclusive."""
        full, top = (1 << self.n) - 1, 1 << self.n - 1
        plus, minus, score = full, 0, self.n
        best, end = self.n, 0
        for j, c in enumerate(text, 1):
            same = self.masks.get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, j
            up, down = up << 1 & full, down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
        return best, end


class Block:
    """The automaton of a block of items and their verifiers."""

    def __init__(self, items: tuple[tuple[int, str], ...], error_rate: float):
        self.items = items
        self.errors = [int(error_rate * len(t)) if len(t) >= MIN_CHARS else 0 for _, t in items]
        self.verify = [Myers(t) for _, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.errors[i]):
                where.setdefault(piece, []).append((i, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def matches(self, text: str, first_only: bool = False) -> list[tuple[int, int, int]]:
        """``(item_id, distance, end)`` of each item within its budget in a normal text: its best place, the first of equals."""
        if self.empty:
            return []
        tried: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int]] = {}
        for last, places in self.automaton.iter(text):
            for i, upto in places:
                begin, k = last + 1 - upto, self.errors[i]
                if self.verify[i].n < MIN_CHARS:  # the one piece is the item
                    if i not in found and on_word_borders(text, begin, last + 1):
                        found[i] = (0, last + 1)
                        if first_only:
                            return [(self.items[i][0], *found[i])]
                    continue
                # Places within the budget of one another are verified together, from the first of them.
                slot = begin // (k + 1)
                if (i, slot) in tried or (i in found and found[i][0] == 0):
                    continue
                tried.add((i, slot))
                low = max(0, slot * (k + 1) - k)
                distance, end = self.verify[i].search(text[low : (slot + 1) * (k + 1) + self.verify[i].n + k])
                if distance <= k and (i not in found or (distance, low + end) < found[i]):
                    found[i] = (distance, low + end)
                    if first_only:
                        return [(self.items[i][0], *found[i])]
        return [(self.items[i][0], *place) for i, place in sorted(found.items())]


@lru_cache(maxsize=4)
def _block(items: tuple[tuple[int, str], ...], error_rate: float) -> Block:
    return Block(items, error_rate)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items by blocks, in id order. Null ids or texts and items without normal characters are left out."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held: list[tuple[int, str]] = []
    size = 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        held.append((row["id"], text))
        size += len(text)
        if size >= block_chars:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, end)``: every item that stands in a document within its budget.

    ``end`` is the place behind the best passage in the normal text. A null text holds nothing; repeated documents and
    repeated items are told each; without items there are no rows. Ids of items are strings or integers. No shuffle.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    named = isinstance(items.schema["item_id"].dataType, StringType)
    item_kind = pa.string() if named else pa.int64()
    slim = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item_id {'string' if named else 'long'}, distance int, end long"
    out: list[DataFrame] = []
    for block in item_blocks(items, block_chars=block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            searched = _block(block, error_rate)
            for b in batches:
                ids, found = b.column(0), [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) for m in searched.matches(normal(t))]
                rows = list(zip(*found)) or [(), (), (), ()]
                picked = ids.take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([picked, pa.array(rows[1], item_kind), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], ["id", "item_id", "distance", "end"])

        if out:  # of several blocks, what an earlier one found is written, so that its closure needn't stay on the driver
            out[-1] = written(out[-1], "leaks")
        out.append(slim.mapInArrow(run, schema))
    found = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item stands within its budget, all columns kept; a null text is clean.

    What a block of items leaves is written before the next one, so the plan and the driver hold one block at a time.
    """
    held: DataFrame | None = None
    for i, block in enumerate(item_blocks(items, block_chars=block_chars)):
        if i:
            left = written(docs, "clean")
            if held is not None:
                discard(held)
            docs = held = left

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            searched = _block(block, error_rate)
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not t or not searched.matches(normal(t), first_only=True) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
