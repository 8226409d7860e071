"""What the operators share: reading tables, reliable checkpoints, worker-side caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmart.shared import fresh_path

#: Rows and bytes of an Arrow batch, whichever is reached first. Texts may be megabytes long, so ten thousand of them
#: would not fit a worker. Every operator sets the same values, so no bound hangs on the order of calls.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the plans that are run from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``, by Spark's reader, so any store that Spark reads will do."""
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` has made. Nothing that is still to be computed may read them."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides by their key. Spark takes the bytes of a file for those of the rows made of
    it: blocks exploded from a small file, or compressed links, would be gathered and broadcast by the driver."""
    return df.hint("merge")


class TwoAgeCache(dict):
    """A memo for a worker, bounded by bytes: ``make(key)`` fills it; when the young age is full, it becomes the old one.

    Keys in use move back to the young age, keys not asked for since go when the next age begins, so at most twice
    ``limit`` bytes are held and words of frequent use stay. Keys of over ``LONGEST`` characters are made each time.
    ``item_bytes`` says what a value of ``n`` elements takes at most; ``ENTRY`` covers both objects' heads and the table.
    """

    LONGEST, ENTRY = 64, 200

    def __init__(self, make: Callable[[str], object], limit: int, item_bytes: int = 1):
        super().__init__()
        self.make, self.limit, self.item_bytes, self.old, self.used = make, limit, item_bytes, {}, 0

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.LONGEST:
                return value
        if self.used >= self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        self.used += self.ENTRY + len(key) + self.item_bytes * len(value)
        return value
