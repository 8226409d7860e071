"""Byte-level BPE from a vocabulary file: encode by a priority queue of merge ranks, decode by joining vocabulary strings.

A word is a doubly linked list of symbols. Every adjacent pair that may merge stands in a heap under (rank, position);
a popped entry whose symbols have changed since is stale and skipped. A merge links the left symbol past the right one
and enters the two pairs it has made.

Words repeat, so each worker keeps a bounded memo from a word to its ids; the text around a word can't change its
ids once the pre-tokenizer has cut it out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import TwoAgeCache

#: Fixed value: the published pattern that cuts text into words before byte-level merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of the young age of a worker's memo of words.
MEMO_BYTES = 80 << 20


def printable_bytes() -> dict[int, str]:
    """The published mapping of bytes to printable characters: visible Latin-1 stays, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Dependent(Exception):
    """A word whose ids may depend on what stands before it."""


class ByteBPE:
    """``encode(text)`` gives ids as the vocabulary's own library does without added specials; ``decode(ids)`` the text.

    Strings of added tokens (``<|endoftext|>``) inside a text become their own id. ``decode`` keeps them.
    """

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, shown = spec["model"]["vocab"], printable_bytes()
        back = {c: b for b, c in shown.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.byte_id = [vocab[shown[b]] for b in range(256)]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.piece = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece |= {i: s.encode() for s, i in self.added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(WORDS)
        self.decimal = {i: str(i) for i in self.piece}
        self.by_word = TwoAgeCache(self._word, memo // 4, 8)
        self.by_piece = TwoAgeCache(self._piece, memo, 8)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = [self.byte_id[b] for b in word.encode()]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merge = self.merge
        heap = [(*found, i) for i in range(n - 1) if (found := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)  # (rank, new id, position): rank and position decide, as a rank has one new id
        while heap:
            rank, new, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or merge.get((ids[i], ids[j])) != (rank, new):
                continue  # stale
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if found := merge.get((new, ids[k])):
                    heapq.heappush(heap, (*found, i))
            if (h := left[i]) >= 0 and (found := merge.get((ids[h], new))):
                heapq.heappush(heap, (*found, h))
        return tuple(i for i in ids if i >= 0)

    def _plain(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.by_word.__getitem__, self.words.findall(text))))

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of what follows one space or line end; only if it begins with a visible character are they its own."""
        own = piece[1:] if piece[:1] == "\n" else piece
        if not own or own[0].isspace():
            raise _Dependent
        found = self.words.findall(piece if own is not piece else " " + piece)
        return self._word(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(self.by_word.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        if self.cut_added is None or not any(s in text for s in self.added):
            return self._part(text)
        out: list[int] = []
        for part in self.cut_added.split(text):
            out += [self.added[part]] if part in self.added else self._part(part)
        return out

    def _part(self, text: str) -> list[int]:
        # A space or line end before a visible character begins a word whatever stands before it, so text can be
        # cut there by str.split, which is much faster than the pattern. Other texts take the pattern throughout.
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return list(chain(self._plain(first), chain.from_iterable(map(self.by_piece.__getitem__, rest))))
        except _Dependent:
            return list(self._plain(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        """The ids in decimal, with commas between."""
        return ",".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    """One codec for a vocabulary file in each worker."""
    return ByteBPE(path)


def tokenized(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """Encode every text and decode its ids again, in one pass: ``(id, n_tokens, ids_sha256, decoded_sha256)``.

    ``extra`` adds ``ids`` (array<int>) or ``decoded``, the text that the ids give. No shuffle: a document's ids depend
    on its own text alone. A null text counts as empty; repeated rows and null ids stay.
    """
    if extra not in (None, "ids", "decoded"):
        raise ValueError(f"no such column: {extra}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in batches:
            counts, coded, digests, more = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                back = bpe.decode(ids)
                counts.append(len(ids))
                coded.append(hashlib.sha256(bpe.joined(ids).encode()).hexdigest())
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                if extra:
                    more.append(pa.array(ids, pa.int32()) if extra == "ids" else back)
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(digests, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if extra == "ids":
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(more) if more else pa.array([], pa.int32())))
            elif extra:
                columns.append(pa.array(more, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names + [extra] * bool(extra))

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    added = {None: "", "ids": ", ids array<int>", "decoded": ", decoded string"}[extra]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{added}"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
