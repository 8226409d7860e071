"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode and an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-quillmart-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quillmart-{what}-{uuid.uuid4().hex}"


#: Bytes of a file that Spark may take for a small table before it runs, and of rows that it may broadcast once it has
#: counted them. Files are compressed and computed texts count for little in estimates, so the first is the smaller one.
PLANNED_BROADCAST, MEASURED_BROADCAST = "1MB", "10MB"


def measured_joins(spark: SparkSession) -> None:
    """Let joins broadcast what has been measured to be small, not what is estimated to be; for the plans that are run from now on."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", PLANNED_BROADCAST)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED_BROADCAST)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, for work that is long beside the bytes it reads: a small file is one task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def once_for_each(df: DataFrame, inputs: dict[str, Column], outputs: dict[str, Column], make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with ``outputs``, which are made of ``inputs`` alone and by their names, once for each distinct row of them.

    ``make`` adds columns to the distinct inputs, one row for each, before the outputs are taken from them.
    """
    names = {n: f"__input_{i}" for i, n in enumerate(inputs)}
    given = spread(df.select(*(c.alias(n) for n, c in inputs.items())).distinct())
    made = (make(given) if make else given).select(*(F.col(n).alias(names[n]) for n in inputs), *(c.alias(n) for n, c in outputs.items()))
    keyed = df.withColumns({f"{names[n]}_of": c for n, c in inputs.items()})
    same = reduce(lambda a, b: a & b, (F.col(f"{n}_of").eqNullSafe(F.col(n)) for n in names.values()))
    return keyed.join(made, same, "left").drop(*names.values(), *(f"{n}_of" for n in names.values()))


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df``, written to the shared folder and read again: computed once, however often it is used."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that :func:`stored` has made. Nothing that is still to be computed may read them."""
    for t in tables:
        jvm, spark = t.sparkSession.sparkContext._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
