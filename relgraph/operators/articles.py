"""Article lists: cleaning, URL dedupe, caps per section, quotas, time-window replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.functions.roster import date_or_today, or_blank, present, run_date
from relgraph.session import cut
from relgraph.skew import first_n_per_group, serial_ids


def usable_articles(articles: DataFrame, now: Column) -> DataFrame:
    """Drop rows without title element or link; fill the press and the date."""
    return (
        articles.where(F.col("title").isNotNull() & present(F.col("url")))
        .withColumn("press", or_blank(F.col("press")))
        .withColumn("date", date_or_today(F.col("date"), now))
    )


def with_section_rank(articles: DataFrame, sections: list[str] = ()) -> DataFrame:
    """Add ``section_rank``, by which sections are ordered.

    The listed ones come first, in their order, then all others by name, then null. It is a
    struct that compares in that order, so it needs no list of all sections and no numbering.
    """
    section = F.col("section")
    place = F.array_position(F.array(*map(F.lit, sections)).cast("array<string>"), section)
    listed = F.coalesce(place, F.lit(0))
    tier = F.when(section.isNull(), 2).when(listed > 0, 0).otherwise(1)
    name = F.when((tier == 1), section).otherwise(F.lit(""))
    return articles.withColumn("section_rank", F.struct(tier.alias("tier"), listed.alias("place"), name.alias("name")))


def first_seen(articles: DataFrame) -> DataFrame:
    """One row per URL: the earliest by (section_rank, pos).

    A minimum is combined before the shuffle, so a URL with very many copies costs
    no more than any other.
    """
    place = F.struct("section_rank", "pos")
    cols = [c for c in articles.columns if c != "url"]
    return (
        articles.groupBy("url")
        .agg(F.min_by(F.struct(*cols), place).alias("row"))
        .select("url", "row.*")
    )


def unseen(articles: DataFrame, seen: DataFrame) -> DataFrame:
    """Articles whose URL is not among the seen ones."""
    return articles.join(seen.select("url"), "url", "left_anti")


def _first_in_section(articles: DataFrame) -> DataFrame:
    return articles.groupBy("section_rank", "url").agg(F.min("pos").alias("pos"))


def dedupe_then_cap(articles: DataFrame, cap: int, sections: list[str] = ()) -> DataFrame:
    """Per section in order: the first ``cap`` URLs not kept by an earlier section.

    The ordered choice is worked out for all sections at once, in rounds: from what every
    section keeps follows which URLs are lost to an earlier one, and from that what every
    section keeps. The first section is right from the start, the second after one round, and
    so on; when a round changes nothing, every section agrees with those before it, which
    only the ordered choice does. Rounds see the first rows of each section only; where these
    don't suffice to fill a section that has more, four times as many are taken.
    """
    ranked = with_section_rank(articles, sections)
    own = cut(_first_in_section(ranked), "sections")
    order, depth = [F.col("pos"), F.col("url")], 2 * cap
    while True:
        heads = first_n_per_group(own, ["section_rank"], order, depth + 1, ["url"])
        heads = cut(heads.withColumnRenamed("rank", "place"), "heads")
        rows = heads.where(F.col("place") <= depth)
        kept, before = rows.where(F.col("place") <= cap), None
        while True:
            kept = cut(kept.select("section_rank", "url", "pos"), "kept")
            now = kept.agg(F.count("*"), F.sum(F.xxhash64("section_rank", "url").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
            taken = kept.groupBy("url").agg(F.min("section_rank").alias("by"))
            free = rows.join(taken, "url", "left").where("by is null or by >= section_rank")
            nth = F.row_number().over(Window.partitionBy("section_rank").orderBy(*order))
            kept = free.withColumn("nth", nth).where(F.col("nth") <= cap)
        filled = kept.groupBy("section_rank").agg(F.count("*").alias("n"))
        more = heads.where(F.col("place") > depth).select("section_rank")
        if more.join(filled, "section_rank", "left").where(F.coalesce("n", F.lit(0)) < cap).isEmpty():
            return ranked.join(kept, ["section_rank", "pos", "url"], "left_semi")
        depth *= 4


def cap_then_dedupe(articles: DataFrame, cap: int, sections: list[str] = ()) -> DataFrame:
    """Per section the first ``cap`` distinct URLs; a URL lost to an earlier section is not replaced."""
    ranked = with_section_rank(articles, sections)
    capped = first_n_per_group(_first_in_section(ranked), ["section_rank"], [F.col("pos"), F.col("url")], cap, ["url"])
    kept = capped.groupBy("url").agg(F.min(F.struct("section_rank", "pos")).alias("at"))
    kept = kept.select("url", "at.section_rank", "at.pos")
    return ranked.join(kept, ["section_rank", "pos", "url"], "left_semi")


def section_counts(articles: DataFrame, minimum: int, sections: list[str] = ()) -> DataFrame:
    """``(section, n, short)`` for every section there is and every listed one, also the empty ones."""
    counts = articles.groupBy("section").agg(F.count("*").alias("n"))
    listed = articles.sparkSession.createDataFrame([(s, 0) for s in sections], "section string, n long")
    summed = counts.unionByName(listed).groupBy("section").agg(F.sum("n").alias("n"))
    return summed.select("section", "n", (F.col("n") < minimum).alias("short"))


def replace_last_hour(existing: DataFrame, new: DataFrame, now: Column, order: str) -> DataFrame:
    """Drop stored rows younger than one hour, append the batch with fresh ids.

    Ids go on after the largest id ever given, also when its row is dropped. An
    empty batch still drops.
    """
    kept = existing.where(F.col("inserted_at") < now - F.expr("INTERVAL 1 HOUR"))
    last = existing.agg(F.max("id")).first()[0] or 0
    numbered = (
        serial_ids(new, order, start=last)
        .withColumn("inserted_at", now)
        .withColumn("base_date", run_date(now))
    )
    return kept.unionByName(numbered.select(*kept.columns))


def gated(names: Column, content: Column) -> Column:
    """Only articles with two or more names and a text are scored."""
    return (F.size(names) >= 2) & present(content)


def article_rows(batch: DataFrame, *first: str) -> DataFrame:
    """Scored articles in the column order of the stored table, after the named first columns."""
    return batch.select(
        *first,
        "title",
        "url",
        "press",
        "date",
        F.array_join("politicians", ",").alias("politicians"),
        "sentiment_label",
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "content",
    )
