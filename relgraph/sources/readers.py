"""Readers. Every reader states its schema and keeps the source order as ``ordinal``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from relgraph.functions.roster import or_blank
from relgraph.schemas import CAREER_FIELDS, PERSON_CSV, ROSTER, ROSTER_FIELDS


def roster_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Rosters stored as one JSON array per file.

    Files are read side by side; the place in the file, after the file name, is the
    order. One array cannot be split, so a roster larger than a task should be
    stored as lines (`roster_lines`). A file that is no such array fails the job.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", ArrayType(ROSTER), {"mode": "FAILFAST"}).alias("rows")
    )
    return normal_roster(
        files.select("file", F.posexplode("rows").alias("place", "r")).select(
            F.struct("file", "place").alias("ordinal"), "r.*"
        )
    )


def roster_lines(spark: SparkSession, path: str, ordinal: str) -> DataFrame:
    """Rosters stored as JSON lines, read in parallel; ``ordinal`` names their order field."""
    rows = spark.read.schema(StructType([*ROSTER.fields, StructField(ordinal, LongType())])).json(path)
    return normal_roster(rows.select(F.col(ordinal).alias("ordinal"), *[f"`{c}`" for c in ROSTER.fieldNames()]))


def normal_roster(rows: DataFrame) -> DataFrame:
    """One set of columns for all roster variants."""

    def either(keys: list[str]) -> Column:
        return F.coalesce(*[F.col(f"`{k}`") for k in keys])

    return rows.select(
        "ordinal",
        *[either(keys).alias(name) for name, keys in ROSTER_FIELDS.items()],
        either(CAREER_FIELDS).alias("careers"),
    )


def person_csv(spark: SparkSession, path: str) -> DataFrame:
    """People with spouse and family; empty cells are null. The row order is not kept by a
    parallel read, so the whole row breaks ties between rows of one name."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").schema(PERSON_CSV).csv(path)
    return rows.select(
        "name",
        "wiki_url",
        F.col("출생지").alias("birth_place"),
        F.col("소속").alias("party"),
        F.col("배우자").alias("spouse"),
        F.col("가족").alias("family"),
    ).withColumn("ordinal", F.xxhash64("wiki_url", "birth_place", "party", "spouse", "family"))


def page_corpus(pages: DataFrame) -> DataFrame:
    """Fetched pages with a good status; all pages when there is no status column."""
    return pages.where(F.col("status") == 200) if "status" in pages.columns else pages


def blanks_filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: or_blank(F.col(c)) for c in columns})
