"""Edge counts and the article table kept up to date by streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from relgraph.operators.tables import merge_counts, sentiment_edges
from relgraph.sources.writers import save_articles

DELTA = "name1 string, name2 string, type string, count long, via_article string, seq long"


FOLD = 8
"""Closed batches that are folded into the base table at once."""


def start_edge_counts(
    scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fold: int = FOLD
) -> StreamingQuery:
    """Write the polarity edge counts of each micro-batch below ``path``.

    A batch owns the folder of its number and overwrites it, so a batch that is
    run again after a failure is not counted twice. When ``fold`` batches before the
    current one are there, they and the last base table become the next base table, which is
    named by the last batch in it; a batch that a base table holds is not written again.
    So readers meet one base table and a few batches however long the stream has run.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, batches = stored_counts(spark, path)
        if base is not None and number <= base:
            return
        sentiment_edges(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        # the newest batch may come again
        closed = [n for n in batches if n < number]
        if len(closed) >= fold:
            edge_counts(spark, path, upto=closed[-1]).write.mode("overwrite").parquet(f"{path}/base={closed[-1]}")
            # what the base before this one was made of goes now: nobody can still be reading it
            if base is not None:
                _drop(spark, path, base)

    return (
        scored.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int, object]]:
    """kind, number and path of the finished folders of a stream."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(jvm.Path(path, "{base,batch}=*")) or []]
    done = [p for p in found if fs.exists(jvm.Path(p, "_SUCCESS"))]
    return [(*_named(p.getName()), p) for p in done]


def _named(folder: str) -> tuple[str, int]:
    kind, number = folder.split("=")
    return kind, int(number)


def stored_counts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last batch in the newest base table (None without one), and the batches after it."""
    folders = _folders(spark, path)
    base = max((n for kind, n, _ in folders if kind == "base"), default=None)
    return base, sorted(n for kind, n, _ in folders if kind == "batch" and (base is None or n > base))


def _drop(spark: SparkSession, path: str, upto: int) -> None:
    for _, number, folder in _folders(spark, path):
        if number <= upto:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def edge_counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Current edge table: the newest base table and the batches after it (up to a batch)."""
    base, batches = stored_counts(spark, path)
    parts = [f"{path}/batch={n}" for n in batches if upto is None or n <= upto]
    parts += [f"{path}/base={base}"] if base is not None else []
    return merge_counts(spark.read.schema(DELTA).parquet(*parts) if parts else spark.createDataFrame([], DELTA))


def start_article_replace(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    order: str,
    clock: Callable[[int], datetime],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Replace-last-hour ingestion: every micro-batch is one run at the time ``clock`` gives it.

    ``clock`` must give a repeated batch number the same time again.
    """

    def store(batch: DataFrame, number: int) -> None:
        save_articles(batch.sparkSession, batch, path, clock(number), order)

    return (
        scored.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
