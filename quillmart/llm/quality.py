"""Quality by compression: a text is good if a dictionary of good text shortens it more than one of bad text does.

Two zstandard dictionaries are built from labelled texts, one of good and one of bad ones. A text's feature is the
difference of both compressed sizes, divided by its bytes and ``SHORT`` more (so that a few bytes of a short text say
little). A logistic curve, fitted to labelled texts that are in neither dictionary, turns the feature into a probability.
Texts are compressed whole, in parts of ``PART`` bytes that know nothing of each other: else a long text would become
its own dictionary and the difference vanish.

What is fitted is bounded: ``TEXTS`` labelled texts of each class (those of the least hashes of their ids, one text an
id), of which a third calibrates, and ``PARTS`` parts of the others for a dictionary. The driver gets those parts and a
feature for each calibrating text. The shares of good and bad are counted over all labelled rows, every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmart.llm.common import written

#: Bounds of the sample: texts of each class, and parts of them in a dictionary.
TEXTS, PARTS = 3000, 4000
#: Bytes that are compressed by themselves, of a dictionary, and that are added to a text's length; zstandard's level.
PART, DICTIONARY, SHORT, LEVEL = 1024, 256 << 10, 64, 3
#: The score from which a text counts as good. Good texts are many, and losing one costs more than keeping a bad one.
THRESHOLD = 0.3
FOLDS = 5
#: One text in so many calibrates.
CALIBRATING = 3


def parts(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + PART] for i in range(0, len(data), PART)]


class Sizes:
    """The feature of a text under two dictionaries (bytes of trained or plain content)."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = []
        for content in (bad, good):
            made = zstandard.ZstdCompressionDict(content)
            made.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def feature(self, text: str) -> float:
        """By how many bytes of its own the good dictionary shortens the text more than the bad one."""
        by_bad, by_good = self.compress
        cut = parts(text)
        return sum(len(by_bad(p)) - len(by_good(p)) for p in cut) / (sum(map(len, cut)) + SHORT)


@dataclass
class Model:
    """Without both dictionaries every text has the score of ``intercept``."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * features + self.intercept, -40, 40)))


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on the samples; of too few to train on, their last ``size`` bytes as plain content."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def calibrate(x: np.ndarray, y: np.ndarray, share: float, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of ``x``, classes weighted so that ``share`` of them is good.

    Newton's method on the log-likelihood with targets drawn in by one text of each class, which bounds the slope where
    both classes lie apart. Features are scaled by their deviation first.
    """
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    w = np.array([0.0, np.log(share / (1 - share))])

    def loss(w: np.ndarray) -> float:
        f = z @ w
        return float((weight * (np.logaddexp(0, f) - target * f)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (weight * (p - target))
        move = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from training: crc32 of its id as text, modulo FOLDS, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample of rows that aren't held out.

    ``labels`` has ``id, quality`` (1 is good); a null label is none, of several labels of an id the lowest holds. An id
    that comes with several texts gives the least of them. Where a class has no text to make a dictionary of or to
    calibrate by, every text gets the share of good labels (a half without labels).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min("quality") == 1).cast("int").alias("good")).where(~held_out(id_col))
    counted = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counted.get(1, 0) + 1) / (sum(counted.values()) + 2)
    model = Model(intercept=float(np.log(share / (1 - share))))
    first = F.xxhash64(F.col(id_col))
    chosen = [known.where(F.col("good") == g).orderBy(first, id_col).limit(TEXTS) for g in (0, 1)]  # at most 2 * TEXTS ids
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen[0].unionByName(chosen[1])), id_col)
    whole = texts.groupBy(id_col, "good").agg(F.min("text").alias("text"))
    sample = written(whole.select("good", (F.pmod(first, F.lit(CALIBRATING)) == 0).alias("calibrates"), F.hash(first).alias("h"), "text"), "quality-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for good, h, text in zip(*(c.to_pylist() for c in b.columns)):
                some = [p for p in parts(text) if len(p) >= 8]
                yield pa.RecordBatch.from_arrays([pa.array([good] * len(some), pa.int32()), pa.array([h] * len(some), pa.int32()), pa.array(some, pa.binary())], ["good", "h", "part"])

    pieces = sample.where(~F.col("calibrates")).select("good", "h", "text").mapInArrow(cut, "good int, h int, part binary")
    made = []
    for g in (0, 1):
        taken = pieces.where(F.col("good") == g).select("part", F.xxhash64("part", "h").alias("order")).orderBy("order", "part").limit(PARTS)
        made.append([bytes(r["part"]) for r in taken.collect()])
    if not all(made):
        return model
    bad, good = map(dictionary, made)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sizes.feature(t) for t in b.column(1).to_pylist()], pa.float64())], ["good", "x"])

    rows = sample.where("calibrates").select("good", "text").mapInArrow(measure, "good int, x double").toArrow()
    y, x = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    if 0 < y.sum() < len(y):
        order = np.lexsort((y, x))  # rows come in any order; sums of floats should not
        model = Model(good, bad, *calibrate(x[order], y[order], share))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (0 to 1, higher is better).

    A null text counts as empty, whose feature is 0. A column called ``quality_score`` is replaced. Rows stay as they are
    in number and order within partitions.
    """
    base = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.good and model.bad else None
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            x = np.array([sizes.feature(t or "") if sizes else 0.0 for t in texts])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*b.schema.names, "quality_score"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("quality_score", DoubleType())]))
