"""Fill-in-the-middle examples, cut by a piecewise-linear learned index over token boundaries.

A text of ``n`` tokens (a run of ASCII letters, or any other single character) has ``n + 1`` boundaries. Its rank index
is a list of straight segments that predict the code-point offset of boundary ``k`` to within ``ERROR``, and one stored
byte for each boundary that says how far the prediction is off. A cut asks for a boundary by its rank: the segment is
found by bisection, its line predicts the offset, and the residual corrects it exactly. A stored index serves any number
of seeds without cutting the text into tokens again.

Layout of an index, little-endian: u32 segments, u64 boundaries; for each segment u64 first rank, u64 offset there, f64
slope; then a signed byte for each boundary.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: How far a line may be off; rounding down adds one, and the sum has to fit into a signed byte.
ERROR = 126
#: Boundaries that are looked at first when a segment is fitted; each further look takes twice as many.
WINDOW = 1024
#: Marks of prefix, suffix and middle, and the shares of plain and of suffix-first examples in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets of all token boundaries, the text's two ends included."""
    if not text:
        return np.zeros(1, np.int64)
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((codes | 32) - codes.dtype.type(97)) < 26
    inside = letter[1:] & letter[:-1]
    return np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(codes)]])


class RankIndex:
    """``index[k]`` is the offset of boundary ``k``."""

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, residuals: np.ndarray):
        self.first, self.base, self.slope, self.residuals = first, base, slope, residuals
        self.ranks = first.tolist()

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Greedy segments: each is as long as the cone of slopes that keep all its boundaries within ``error`` is not empty."""
        pieces, i, n = [], 0, len(offsets)
        while i < n:
            low, high, at, width = 0.0, np.inf, i + 1, WINDOW
            while at < n:
                y = (offsets[at : at + width] - offsets[i]).astype(np.float64)
                x = np.arange(at - i, at - i + len(y), dtype=np.float64)
                lows = np.maximum.accumulate(np.maximum((y - error) / x, low))
                highs = np.minimum.accumulate(np.minimum((y + error) / x, high))
                empty = lows > highs
                fit = int(empty.argmax()) if empty[-1] else len(y)  # once empty, the cone stays so
                if fit:
                    low, high = lows[fit - 1], highs[fit - 1]
                at += fit
                if fit < len(y):
                    break
                width *= 2
            pieces.append((i, int(offsets[i]), (low + high) / 2 if at > i + 1 else 0.0))
            i = at
        first, base, slope = (np.array(c, t) for c, t in zip(zip(*pieces), ("<u8", "<u8", "<f8")))
        index = cls(first, base, slope, np.zeros(n, np.int8))
        segment = np.repeat(np.arange(len(first)), np.diff(np.append(first, n).astype(np.int64)))
        within = np.arange(n) - first.astype(np.int64)[segment]
        off = offsets - (base.astype(np.int64)[segment] + np.floor(slope[segment] * within).astype(np.int64))
        if np.abs(off).max(initial=0) > 127:
            raise ValueError(f"an error of {error} does not fit into a byte")
        index.residuals = off.astype(np.int8)
        return index

    def __len__(self) -> int:
        return len(self.residuals)

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        s = bisect_right(self.ranks, k) - 1
        return int(self.base[s]) + int(np.floor(self.slope[s] * (k - self.ranks[s]))) + int(self.residuals[k])

    def to_bytes(self) -> bytes:
        parts = (self.first, self.base, self.slope, self.residuals)
        return struct.pack("<IQ", len(self.first), len(self)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> RankIndex:
        m, n = struct.unpack_from("<IQ", data)
        first, base, slope = (np.frombuffer(data, t, m, 12 + 8 * m * i) for i, t in enumerate(("<u8", "<u8", "<f8")))
        return cls(first, base, slope, np.frombuffer(data, np.int8, n, 12 + 24 * m))


def with_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``rank_index``, the index of each whole text as bytes; a null text counts as empty.

    A column called ``rank_index`` is replaced. Rows stay as they are in number and order.
    """
    base = docs.drop("rank_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            made = [RankIndex.fit(boundaries(t or "")).to_bytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, "rank_index"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("rank_index", BinaryType())]))


def draws(key: object, seed: int) -> list[int]:
    """The first four 32-bit numbers of sha256 of ``seed:key``."""
    name = "null" if key is None else str(key)
    return list(struct.unpack(">4I", hashlib.sha256(f"{seed}:{name}".encode()).digest()[:16]))


def examples(
    docs: DataFrame,
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    index_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every text: ``n`` tokens, cut at two drawn boundaries.

    ``form`` is ``plain`` (the text as it is: ``plain_percent`` of the draws, empty texts, texts that hold a mark),
    ``spm`` (suffix first: ``spm_percent`` of the others) or ``psm``. Draws hang on the seed and the id alone. Lengths are
    code points, null where plain. ``index_col`` names a column of stored indexes; without it they are fitted on the way.
    A null text counts as empty, a null id draws as the word ``null``; repeated rows stay, an empty table gives no rows.
    No shuffle; a task holds one text's index at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, given = (b.column(i).to_pylist() for i in range(3))
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for key, text, stored in zip(keys, texts, given):
                index = RankIndex.from_bytes(stored) if stored is not None else RankIndex.fit(boundaries(text))
                n = len(index) - 1
                h1, h2, h3, h4 = draws(key, seed)
                counts.append(n)
                if not text or h3 % 100 >= 100 - plain_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                a, z = (index[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:z], text[z:]
                forms.append("spm" if h4 % 100 < spm_percent else "psm")
                prefixes.append(a)
                middles.append(z - a)
                head = SUFFIX + suffix + PREFIX + prefix if forms[-1] == "spm" else PREFIX + prefix + SUFFIX + suffix
                outputs.append(head + MIDDLE + middle)
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), *(pa.array(c, pa.int64()) for c in (prefixes, middles)), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    index = F.lit(None).cast("binary") if index_col is None else F.col(index_col)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), index.alias("given"))
    made = slim.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that an example was made of. No text that is cut holds a mark, so the marks part the output."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # an empty part first, as the output begins with a mark

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i))

    return F.when(form == "plain", output).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(F.concat(part(2), part(4), part(3)))


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Examples with digests in place of their outputs, and of the texts restored from them."""
    restored = restore(F.col("output"), F.col("form"))
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


#: The same in DuckDB, with a list of tokens instead of the index.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS z,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                       OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain'
                  WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:z], ''), '') AS m,
             coalesce(array_to_string(w[z + 1:], ''), '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
