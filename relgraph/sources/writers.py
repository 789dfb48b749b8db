"""Sinks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from relgraph.operators.articles import article_rows
from relgraph.skew import serial_ids


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that fills while any sink runs: ``observation.get["rows"]``."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 as is."""
    df.write.mode("overwrite").json(path)


def union_of_keys(parts: list[DataFrame]) -> DataFrame:
    """Records of different shape under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flat_texts(df: DataFrame) -> DataFrame:
    """Columns in sorted order, lists joined with ``'; '``, nulls as ``''``."""

    def flat(c: str) -> Column:
        if isinstance(df.schema[c].dataType, ArrayType):
            return F.coalesce(F.array_join(f"`{c}`", "; "), F.lit(""))
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    return df.select(*[flat(c).alias(c) for c in sorted(df.columns)])


def write_csv(parts: list[DataFrame], path: str) -> None:
    flat_texts(union_of_keys(parts)).write.mode("overwrite").option("header", True).csv(
        path, emptyValue=""
    )


def write_tabs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def load_statement(rel: DataFrame) -> DataFrame:
    """Relations as graph load statements; quotes and backslashes in values are escaped."""

    def quoted(c: str) -> Column:
        twice = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
        return F.replace(twice, F.lit("'"), F.lit("\\'"))

    return rel.select(
        F.format_string(
            "MATCH (a:Person {name: '%s'}), (b:Person {name: '%s'}) "
            "MERGE (a)-[r:%s {desc: '%s', score: %d}]->(b);",
            quoted("source"),
            quoted("target"),
            F.col("type"),
            quoted("desc"),
            F.col("score"),
        ).alias("value")
    )


def write_statements(rel: DataFrame, path: str) -> None:
    load_statement(rel).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the stored graph. Edges are laid out by type, so one family reads only its own files."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def save_articles(spark: SparkSession, batch: DataFrame, path: str, now: datetime, order: str) -> None:
    """Replace the articles stored within the last hour by this batch.

    Rows of one run share their insertion time, so the table is laid out as
    ``base_date/run`` (run = insertion second) and the replace leaves out whole run
    folders; no stored row is read or rewritten. Which folders make up the table is said by a
    list, ``_live/<run>``, that is put in place by one rename after the run is written: a reader
    sees the table before the run or after it, nothing between. Folders that neither this
    list nor the one before names are deleted, so a reader of the table before can still
    finish. Ids go on after the largest id ever given: each run leaves its last one as
    a folder name below ``_last_ids``. A repeated run overwrites its own folder and list.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = now.astimezone(timezone.utc) if now.tzinfo else now.replace(tzinfo=timezone.utc)
    run = int(now.timestamp())
    day = now.strftime("%Y%m%d")
    before = [f for f in live_runs(spark, path) if _run_of(f) != run]
    marks = jvm.org.apache.hadoop.fs.Path(root, "_last_ids")
    given = [s.getPath().getName().split("-") for s in fs.listStatus(marks)] if fs.exists(marks) else []
    last = max((int(n) for r, n in given if int(r) != run), default=0)
    own = f"base_date={day}/run={run}"
    rows = article_rows(serial_ids(batch, order, start=last), "id").withColumn(
        "inserted_at", F.timestamp_seconds(F.lit(run))
    )
    rows.write.mode("overwrite").parquet(f"{path}/{own}")
    reached = spark.read.parquet(f"{path}/{own}").agg(F.max("id")).first()[0] or last
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(marks, f"{run}-{reached}"))
    floor = int((now - timedelta(hours=1)).timestamp())
    live = [f for f in before if _run_of(f) < floor] + [own]
    _put(fs, jvm, f"{path}/_live/{run}", "\n".join(live))
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "base_date=*/run=*")):
        folder = status.getPath()
        if f"{folder.getParent().getName()}/{folder.getName()}" not in {*live, *before}:
            fs.delete(folder, True)


def _run_of(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])


def _put(fs, jvm, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    target, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def live_runs(spark: SparkSession, path: str) -> list[str]:
    """The run folders that make up the stored table, as the newest list says."""
    jvm = spark.sparkContext._jvm
    lists = jvm.org.apache.hadoop.fs.Path(path, "_live")
    fs = lists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(lists)] if fs.exists(lists) else []
    newest = max((p for p in found if p.getName().isdigit()), key=lambda p: int(p.getName()), default=None)
    if newest is None:
        return []
    source = fs.open(newest)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")).split("\n")
    finally:
        source.close()


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


ARTICLES = (
    "id long, title string, url string, press string, date string, politicians string, "
    "sentiment_label string, sentiment_score double, content string, inserted_at timestamp, "
    "base_date string, run long"
)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The stored articles; a filter on ``base_date`` prunes folders."""
    folders = [f"{path}/{f}" for f in live_runs(spark, path)]
    if not folders:
        return spark.createDataFrame([], ARTICLES)
    return spark.read.option("basePath", path).schema(ARTICLES).parquet(*folders)
