"""Column helpers shared by the operators: words, let-bindings, seeded draws, staging."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def uniform(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that depends on the seed and the keys only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set for checkpoints as well.

    Without the setting a local master (tests) takes a new temporary folder, once for a
    session; a cluster, whose machines don't share such a folder, is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this session wrote, on whatever storage it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the steps that run inside the block.

    A batch stands in the executor and in its Python worker at once; 10,000 whole texts, Spark's
    own number, are some 40 MB in each.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written once to the folder named by ``spark.checkpoint.dir``.

    The files are on shared storage, so they outlive lost executors, and Spark's cleaner
    removes them with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
