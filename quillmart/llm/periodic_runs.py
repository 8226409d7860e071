"""Periodic runs of words: maximal stretches that repeat with a period, found by seeds extended along diagonals.

A run of period ``q`` and length ``L >= max(least, exponent * q)`` matches itself at lag ``q`` over ``L - q`` words, so
it holds two equal k-grams at that lag for every ``k`` up to the overlap that its period guarantees. Periods are taken in
scales: up to 16 with ``k = 16`` (for 24 words and exponent 3, the least overlap of all), then ``(s, 2s]`` with ``k = 2(s + 1)``.
Since ``k`` is at least as large as the scale's periods, a k-gram inside a run of (smallest) period ``q`` comes again
first after exactly ``q`` words. So each occurrence is paired with the next one only, and the pairs are as many as the
words, not as their squares. k-grams are named exactly, by doubling: equal names mean equal words.

A pair is a seed on the diagonal of its lag; it is extended both ways as far as words match, and a table holds, for each
lag, how far the last extension reached, so that later seeds in that part are skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least words of a run, and how many periods it has at least.
LEAST, EXPONENT = 24, 3
#: Words that an extension compares first; each further look takes twice as many.
LOOK = 64
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(text: str) -> list[bytes]:
    """Words between blanks, tabs and line ends (U+0020, U+0009 to U+000D), which is what bytes are split at."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def may_repeat(ids: np.ndarray, k: int) -> bool:
    """Whether any k-gram may come twice, by hashes; False is certain, as equal k-grams have equal hashes."""
    h, have = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD6E8FEB86659FD93), 1
    while have < k:
        step = min(have, k - have)
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        have += step
    h.sort()
    return bool((h[1:] == h[:-1]).any())


class Names:
    """Exact names of k-grams: of ``2m``-grams from the names of both halves, of other lengths from two overlapping ones."""

    def __init__(self, ids: np.ndarray):
        self.size, self.names = 1, ids

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    def of(self, k: int) -> np.ndarray:
        """Names of the k-grams at every position; ``k`` may not fall from call to call."""
        while self.size * 2 <= k:
            self.names = self._pairs(self.names[: -self.size], self.names[self.size :])
            self.size *= 2
        step = k - self.size
        return self._pairs(self.names[:-step], self.names[step:]) if step else self.names


def diagonal(ids: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """First position and end of the stretch around ``i`` in which every word equals the one ``lag`` words later."""
    end, width, last = i, LOOK, len(ids) - lag
    while end < last:
        same = ids[end : min(end + width, last)] == ids[end + lag : min(end + width, last) + lag]
        if not same.all():
            end += int(same.argmin())
            break
        end, width = end + len(same), width * 2
    begin, width = i, LOOK
    while begin > 0:
        low = max(begin - width, 0)
        same = (ids[low:begin] == ids[low + lag : begin + lag])[::-1]
        if not same.all():
            begin -= int(same.argmin())
            break
        begin, width = low, width * 2
    return begin, end


def find_runs(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    if exponent < 3:
        raise ValueError("scales need runs of three periods or more")
    n, found = len(ids), []
    # The overlap max(least - q, (exponent - 1) * q) is least where its parts meet.
    k = min(max(least - q, (exponent - 1) * q) for q in range(1, least + 2))
    if n < max(least, exponent) or not may_repeat(ids, k):
        return found
    names, low, high = Names(ids), 0, k
    while (low + 1) * exponent <= n:
        gram = names.of(k)
        order = np.argsort(gram, kind="stable")
        again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
        if not len(again):
            break  # longer k-grams can't come twice either
        at, lag = order[again], order[again + 1] - order[again]
        some = (lag > low) & (lag <= high)
        at, lag = at[some], lag[some]
        by_lag = np.lexsort((at, lag))
        at, lag = at[by_lag], lag[by_lag]
        new = np.ones(len(at), bool)  # a seed right behind another one of its lag lies on the same extension
        new[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[new].tolist(), lag[new].tolist()):
            if i < covered.get(q, 0):
                continue
            begin, covered[q] = diagonal(ids, i, q)
            length = covered[q] - begin + q
            if length >= max(least, exponent * q):
                found.append((begin, length, q))
        low, high = high, 2 * high
        k = max(least - low - 1, (exponent - 1) * (low + 1))
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def looped(key: object, n: int) -> np.ndarray | None:
    """Word numbers of a text of ``n`` words after a loop is put into it, for one id in ten; None where there is none.

    With ``h = crc32(id as text)``, ``g = h // 10``: if ``h % 10`` is 0, words from ``a = g % n`` on repeat with period
    ``1 + (n - a) // (3 + g % 8)``. A null id has no loop.
    """
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % period])


def collapse(docs: DataFrame, loops: bool = False, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every whole text: its runs by start, then period, and the words that stay.

    A word goes if any run holds it after that run's first period; those that stay are joined by one space. ``loops``
    plants loops by :func:`looped` first, for tests of recall. A null text counts as empty: no words, no runs, an empty
    ``collapsed``. Repeated rows and null ids stay; an empty table gives no rows. No shuffle; a task holds the words of
    one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, runs, kept = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                if loops and (order := looped(key, len(words))) is not None:
                    words = [words[i] for i in order.tolist()]
                found = find_runs(numbered(words), least, exponent) if len(words) >= least else []
                if found:
                    stays = np.ones(len(words), bool)
                    for start, length, period in found:
                        stays[start + period : start + length] = False
                    words, n = [words[i] for i in np.flatnonzero(stays).tolist()], len(words)
                else:
                    n = len(words)
                counts.append(n)
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact ``length / period``; of equal ones the first. Null where there is none."""

    def better(best: Column, r: Column) -> Column:
        return F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)

    first = F.try_element_at(runs, F.lit(1))
    return F.reduce(runs, first, better)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and digests of all runs and of the collapsed text."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
