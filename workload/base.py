"""Registry and shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relgraph.operators import pages as pg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that must agree."""

    def register(run):
        key = name or run.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def page_text_sql() -> str:
    """Body text of the given pages, by the same steps in SQL."""
    text = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in pg.DROPPED_PARTS:
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', '', 'g')"
    body = rf"""CASE WHEN regexp_extract(t, '(?is)<article\b[^>]*>(.*)</article>', 1) <> ''
      THEN regexp_extract(t, '(?is)<article\b[^>]*>(.*)</article>', 1)
      WHEN regexp_extract(t, '(?is)<body\b[^>]*>(.*)</body>', 1) <> ''
      THEN regexp_extract(t, '(?is)<body\b[^>]*>(.*)</body>', 1) ELSE t END"""
    lines = rf"regexp_replace(b, '(?i)</?(?:{pg.BLOCK_TAGS})\b[^>]*>', chr(10), 'g')"
    plain = f"regexp_replace({lines}, '<[^>]*>', '', 'g')"
    for name, char in pg.ENTITIES:
        plain = f"""replace({plain}, '{name}', '{char.replace("'", "''")}')"""
    neat = rf"regexp_replace({plain}, '[ \t\r\n]*\n[ \t\r\n]*', chr(10), 'g')"
    return f"""WITH s AS (SELECT page_id, {text} AS t FROM pages), c AS (SELECT page_id, {body} AS b FROM s)
    SELECT page_id, trim({neat}, ' ' || chr(10)) AS text FROM c"""
