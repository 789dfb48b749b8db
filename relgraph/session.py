"""Session settings and the two ways the library cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "relgraph", master: str = "local[*]", **conf) -> SparkSession:
    """Session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, named)
    return named


_run_folders: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table, in the run's own folder below the shared one.

    A lazily read table may be needed until the program ends; then the folder goes as a whole.
    """
    run = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    if run not in _run_folders:
        _run_folders.add(run)
        atexit.register(_delete, spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm.org.apache.hadoop
        target = jvm.fs.Path(path)
        target.getFileSystem(jvm.conf.Configuration()).delete(target, True)
    except Exception:  # noqa: BLE001  the program ends; the JVM may be gone already
        pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Later stages start from the files, which outlive the executors that wrote
    them; being columnar, each later branch reads only its own columns. Row order
    is not kept.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
