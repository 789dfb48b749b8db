"""Joins and rankings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from relgraph.session import cut

HOT_SHARE = 200
"""A key is hot when it holds more than 1/HOT_SHARE of all rows.

Fewer than HOT_SHARE keys can do so, whatever the data size; that is the proof
behind broadcasting the hot rows.
"""


SPLIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give an input of one read split at most, with heavy work per row, a task per core.

    It would be read by one task. It is small by that very check, so moving it costs
    little; a larger input has several splits and is left as it is.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= SPLIT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


TASK_ROWS = 50_000
"""Rows of a task that sorts them for several windows, about."""


def by_key(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt out by a key to as many tasks as TASK_ROWS asks for.

    Windows and groups by the key then stay in these tasks, whose size does not grow with the table.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // TASK_ROWS)), key)


def lookup_join(big: DataFrame, unique: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``big`` to ``unique`` (one row per ``key``).

    ``rows`` names the column of ``unique`` that tells how many rows of ``big``
    carry the key. Rows of hot keys meet a broadcast of at most HOT_SHARE rows
    and are never shuffled; all others take the usual shuffled join.
    """
    total = unique.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) * F.lit(HOT_SHARE) > F.lit(total)
    hot = unique.where(is_hot)
    on_hot = big.join(F.broadcast(hot), key)
    on_rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        unique.where(~is_hot), key
    )
    return on_hot.unionByName(on_rest)


SALTS = 32


def salted_join(few: DataFrame, many: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join in which one key may hold a large part of ``many``.

    Rows of ``many`` are spread over SALTS parts of their key by a hash of ``by``;
    each row of ``few`` is repeated once per part. No task then holds more than one
    part of a key.
    """
    parts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    repeated = few.withColumn("_part", F.explode(parts))
    parted = many.withColumn(
        "_part", F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(SALTS)).cast("int")
    )
    return repeated.join(parted, [*keys, "_part"]).drop("_part")


def first_n_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, spread: list[str], salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group, exactly, without one task per group.

    Each group is split into ``salts`` parts by a hash of ``spread``; a part keeps
    its own first ``n`` rows, which must include every row of the group's first
    ``n``. The second ranking then sees at most ``salts * n`` rows per group.
    """
    parted = df.withColumn(
        "_part", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts))
    )
    by_part = Window.partitionBy(*group, "_part").orderBy(*order)
    by_group = Window.partitionBy(*group).orderBy(*order)
    return (
        parted.withColumn("_rank", F.row_number().over(by_part))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(by_group))
        .where(F.col("_rank") <= n)
        .drop("_part")
        .withColumnRenamed("_rank", "rank")
    )


RANGE_ROWS = 200_000
"""Keys that are sorted and numbered together."""


def serial_ids(
    df: DataFrame, order: str, start: int | Column = 0, name: str = "id", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Consecutive ids ``start+1, start+2, …`` in the order of a column; rows with equal values in any order.

    A prefix sum in two levels over the column alone: its distinct values are cut into ranges
    of about ``range_rows``, as many as their count asks for; a value's place is the sum of
    all earlier ranges (one row each) and of those before it in its range. The rows themselves
    meet their ids by a hash join, so what else they hold is neither sorted nor in the ranges.
    """
    key = F.col(order).alias("_key")
    values = cut(df.groupBy(key).agg(F.count("*").alias("_n")), "values")
    known = values.agg(F.count("*"), F.max("_n")).first()
    ranges = max(1, -(-known[0] // range_rows))
    ranged = cut(values.repartitionByRange(ranges, "_key").withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_range").agg(F.sum("_n").alias("_m")).select(
        "_range", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    places = ranged.withColumn("_inside", before).join(shifts, "_range").select("_key", (F.col("_shift") + F.col("_inside")).alias("_before"))
    base = F.lit(start) if isinstance(start, int) else start
    met = df.join(places.hint("shuffle_hash"), F.col(order).eqNullSafe(F.col("_key")))
    twin = F.lit(1) if (known[1] or 1) == 1 else F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return met.withColumn(name, base + F.col("_before") + twin).drop("_key", "_before")
