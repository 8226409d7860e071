"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts, unlabelled texts, and a class prior.

A text is the set of its character 5- and 6-grams, hashed; those that confirmed toxic texts hold most above chance are
the features. A linear score is trained in numpy by the risk ``prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))``:
the second part estimates the risk on clean texts from unlabelled ones, of which ``prior`` is toxic; where it falls
below zero the model has begun to fit single texts, and the step goes back instead.

What is fitted is a bounded sample (``POSITIVES`` and ``UNLABELLED`` whole texts, those of the least hashes of their
ids); the prior is counted over all labelled rows, and every whole text is scored, a partition at a time. Tasks count
the sample's n-grams and Spark adds the counts up; the driver gets the features and a bitmap of them for each sampled
text, so what it holds is bounded however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmart.llm.common import written

#: Bound of the sample that is fitted.
POSITIVES, UNLABELLED = 1500, 4500
#: Hashed n-grams, features among them, and least number of sampled toxic texts that hold a feature.
SIZES, BUCKETS_LOG2, FEATURES, LEAST_TEXTS = (5, 6), 22, 2000, 3
#: Training steps, their size, weight decay, and how far the clean risk may go below zero.
STEPS, RATE, DECAY, BELOW = 400, 0.05, 1e-3, 0.0
THRESHOLD = 0.5
FOLDS = 5
#: Positions of a text whose n-grams are hashed at a time, tasks that count the sample, and rows of counts in a batch.
CHUNK, COUNTING, COUNT_ROWS = 1 << 17, 8, 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, one for each position and size, CHUNK positions at a time; letters are lowered, white space is a blank."""
    codes = np.frombuffer((" " + text.lower().replace("\n", " ") + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    base, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    least, most = SIZES[0], SIZES[-1]
    for at in range(0, len(codes) - least + 1, CHUNK):
        part = codes[at : at + CHUNK + most - 1].astype(np.uint64)
        h = part[: len(part) - least + 1].copy()
        for i in range(1, least):
            h *= base
            h += part[i : len(part) - least + 1 + i]
        parts = [h[:CHUNK]]
        for n in SIZES[1:]:
            h = h[: len(part) - n + 1] * base + part[n - 1 :]
            parts.append(h[:CHUNK])
        every = np.concatenate(parts)
        every ^= every >> np.uint64(29)
        yield ((every * mix) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)


def buckets(text: str) -> np.ndarray:
    """The different buckets of a text, sorted."""
    parts = [np.unique(g) for g in grams(text)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32)


@dataclass
class Model:
    """``slots[i]`` is the bucket of feature ``i``; without features every text has the score of ``bias``."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0

    def table(self) -> np.ndarray:
        out = np.full(1 << BUCKETS_LOG2, -1, np.int16)
        out[self.slots] = np.arange(len(self.slots), dtype=np.int16)
        return out

    def score(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        margins = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            parts = [np.unique(table[g]) for g in grams(t)]
            found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int16)
            margins[i] += self.weights[found[found >= 0]].sum()
        return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Both parts of the risk and their gradients by weights and bias: what toxic texts cost, and what clean ones are estimated to."""
    fp, fu = (x @ w.astype(np.float32) + b for x in (xp, xu))
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))

    def gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope.astype(np.float32) @ x, slope.sum()) / len(x)

    toxic = prior * np.logaddexp(0, -fp).mean()
    clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return float(toxic), prior * gradient(xp, sp - 1), float(clean), gradient(xu, su) - prior * gradient(xp, sp)


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear score under the non-negative risk with logistic loss, by Adam over the whole sample."""
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        _, toxic_part, clean_risk, clean_part = risk(xp, xu, w, b, prior)
        g = toxic_part + clean_part if clean_risk >= -BELOW else -clean_part
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def features(sample: DataFrame, positives: int, unlabelled: int) -> np.ndarray:
    """Buckets that the toxic texts of ``sample (s, text)`` hold most above chance; ties go to the smaller bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BUCKETS_LOG2), np.int32)
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[s][buckets(t)] += 1
        some = np.flatnonzero(held.any(axis=0)).astype(np.int32)
        for i in range(0, len(some), COUNT_ROWS):
            at = some[i : i + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[1][at]), pa.array(held[0][at])], ["bucket", "toxic", "other"])

    counts = sample.coalesce(COUNTING).mapInArrow(count, "bucket int, toxic int, other int").groupBy("bucket")
    often = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= LEAST_TEXTS)
    rate_p, rate_u = F.col("toxic") / positives, (F.col("other") + 1) / (unlabelled + 2)
    gain = (F.col("toxic") * F.log(rate_p / rate_u)).alias("gain")
    best = often.where(rate_p > 2 * rate_u).select("bucket", gain).orderBy(F.desc("gain"), "bucket").limit(FEATURES)
    return np.array([r["bucket"] for r in best.collect()], np.int64)


def fit(sample: DataFrame, prior: float) -> Model:
    """Train on ``sample (s, text)``, ``s`` being 1 for toxic and 0 for unlabelled texts. Without texts of both kinds, or
    without features, the model scores all texts alike."""
    model = Model()
    sizes = {r["s"]: r["n"] for r in sample.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0) or not 0 < prior < 1:
        return model
    model.slots = slots = features(sample, sizes[1], sizes[0])
    if not len(slots):
        return model

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Model(slots).table()
        for b in batches:
            maps = []
            for t in b.column(1).to_pylist():
                flags = np.zeros(len(slots), np.uint8)
                found = table[buckets(t)]
                flags[found[found >= 0]] = 1
                maps.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["s", "bits"])

    rows = sample.mapInArrow(bitmaps, "s int, bits binary").toArrow()
    ordered = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    packed = np.frombuffer(b"".join(bits for _, bits in ordered), np.uint8).reshape(rows.num_rows, -1)
    x = np.unpackbits(packed, axis=1, count=len(slots)).astype(np.float32)
    model.weights, model.bias = nnpu(x[sizes[0] :], x[: sizes[0]], prior)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from training: crc32 of its id as text, modulo FOLDS, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample of rows that aren't held out. ``labels`` has ``id, toxic``; a null label is none. An id that
    comes with several texts gives the least of them, so the sample is as bounded as its ids."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic")).where(~held_out(id_col))
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    first = F.xxhash64(F.col(id_col))
    positive = known.where(F.col("toxic") == 1).select(id_col).orderBy(first, id_col).limit(POSITIVES).withColumn("s", F.lit(1))
    others = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col).distinct().orderBy(first, id_col).limit(UNLABELLED).withColumn("s", F.lit(0))
    chosen = positive.unionByName(others)  # at most POSITIVES + UNLABELLED ids
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    whole = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "s").agg(F.min("text").alias("text"))
    sample = written(whole.select("s", "text"), "toxicity-sample")
    return fit(sample, counted["toxic"] / counted["n"] if counted["n"] else 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (0 to 1). A null text counts as empty, which has the score of no feature.

    A column called ``toxicity`` is replaced. Rows stay as they are in number and order within partitions.
    """
    base = docs.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(texts, table), pa.float64())], [*b.schema.names, "toxicity"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("toxicity", DoubleType())]))
