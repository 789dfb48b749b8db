"""Names inside texts, and who is mentioned with whom."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relgraph.functions.roster import present

DICTIONARY_BYTES = 32 << 20
"""A dictionary is sent to the executors up to this size, as counted; a larger one is joined."""

MOST_INITIALS = 256


def name_dictionary(roster: DataFrame, column: str = "name") -> DataFrame:
    """Distinct non-blank names; people of one name become one entry."""
    return roster.where(present(F.col(column))).select(F.col(column).alias("name")).distinct()


SLICE = 64
"""Texts that are Python strings at a time."""


def names_contained(text: Column, names: list[str]) -> Column:
    """Sorted array of the names that occur in the text; overlapping names all count.

    One automaton of all names passes over each text once, however many they are. A task holds
    one Arrow batch, whose bytes are bounded, and SLICE of its texts as strings.
    """
    context = SparkSession.active().sparkContext
    sent = context.broadcast(sorted({n for n in names if n}))

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            if not sent.value:
                yield pa.array([[]] * len(batch), pa.list_(pa.string()))
                continue
            rows = []
            for at in range(0, len(batch), SLICE):
                texts = batch.slice(at, SLICE).to_pylist()
                rows.append(pa.array([sorted({n for _, n in automaton.iter(t)}) if t else [] for t in texts], pa.list_(pa.string())))
            yield pa.concat_arrays(rows) if rows else pa.array([], pa.list_(pa.string()))

    return found(text)


def match_names(
    docs: DataFrame, names: DataFrame, key: str, text: str = "text", out: str = "politicians"
) -> DataFrame:
    """Add the sorted array of dictionary names found in each whole text.

    The texts stay where they are and meet the dictionary there; its size is counted
    first, and one of more than DICTIONARY_BYTES is joined (`match_names_by_grams`).
    """
    known = name_dictionary(names)
    size = known.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if size > DICTIONARY_BYTES:
        return match_names_by_grams(docs, names, key, text, out)
    return docs.withColumn(out, names_contained(F.col(text), [r[0] for r in known.collect()]))


def match_names_by_grams(
    docs: DataFrame, names: DataFrame, key: str, text: str = "text", out: str = "politicians"
) -> DataFrame:
    """Same result for a dictionary of any size: an equi-join on text windows.

    For every name length L the windows of L characters of a text that start like
    some name are listed in one regex pass and joined to the names of that length on equality, so no pair
    of text and name is ever tried by substring search. The text is shuffled once
    by its hash to meet its names, which depend on nothing else: ``key`` may repeat or be null.
    """
    known = name_dictionary(names)
    grams = F.array().cast("array<string>")
    for n, initials in _lengths(known):
        grams = F.concat(grams, F.array_distinct(_windows(F.col(text), n, initials)))
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_t1", F.xxhash64(body)).withColumn("_t2", F.xxhash64(F.lit(1), body))
    hits = (
        docs.select("_t1", "_t2", F.explode(grams).alias("name"))
        .join(known, "name")
        .groupBy("_t1", "_t2")
        .agg(F.sort_array(F.collect_set("name")).alias(out))
    )
    met = docs.join(hits, ["_t1", "_t2"], "left").drop("_t1", "_t2")
    return met.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def _lengths(known: DataFrame) -> list[tuple[int, str]]:
    """Each name length with a pattern for the first characters of its names.

    Only windows that start like some name are listed. The characters come from
    an alphabet and are few; where they are not, any character may start a window.
    """
    first = F.substring("name", 1, 1)
    rows = (
        known.select(F.char_length("name").alias("n"), first.alias("c"))
        .distinct()
        .groupBy("n")
        .agg(F.count("*").alias("size"), F.slice(F.collect_list("c"), 1, MOST_INITIALS + 1).alias("cs"))
        .orderBy("n")
        .collect()
    )
    return [(r.n, "." if r["size"] > MOST_INITIALS else _initials(set(r.cs))) for r in rows]


def _initials(characters: set[str]) -> str:
    if len(characters) > MOST_INITIALS:
        return "."
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(characters)) + "]"


def _windows(text: Column, n: int, initials: str) -> Column:
    """All windows of ``n`` characters that start with one of the initials."""
    # the lookahead has no width, so a window may start at every fitting character
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({initials}.{{{n - 1}}}))"), F.lit(1))


TILE = 256
"""Names of a text that are paired with as many others in one row."""


def pair_rows(df: DataFrame, names: str, keep: list[str]) -> DataFrame:
    """``keep`` and name1 < name2 for every pair of a sorted array, one row each.

    The names are cut into tiles and pairs of tiles become rows of their own, so no row holds
    more than 2 * TILE names of the pairs it makes, and a text with very many names never
    has its pairs in one array.
    """
    tiles = lambda c: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c) / TILE), F.lit(1)).cast("int") - 1)
    tile = lambda c, i: F.slice(c, F.col(i) * TILE + 1, F.lit(TILE))
    rows = df.where(F.size(names) >= 2).select(*keep, F.col(names).alias("_names"), F.explode(tiles(names)).alias("_i"))
    rest = F.slice("_names", F.col("_i") * TILE + 1, F.size("_names"))
    rows = rows.select(*keep, tile("_names", "_i").alias("_left"), rest.alias("_rest"))
    rows = rows.select(*keep, "_left", "_rest", F.explode(tiles("_rest")).alias("_j"))
    rows = rows.select(*keep, F.explode("_left").alias("name1"), tile("_rest", "_j").alias("_right"))
    return rows.select(*keep, "name1", F.explode("_right").alias("name2")).where("name1 < name2")


def co_mentions(docs: DataFrame, names: str = "politicians") -> DataFrame:
    """``(name1, name2, n_docs)``: documents that mention both.

    Equal name sets are counted first, so copies of a text are folded before any
    pair is made and only distinct sets are expanded.
    """
    sets = docs.where(F.size(names) >= 2).groupBy(names).agg(F.count("*").alias("_n"))
    return pair_rows(sets, names, ["_n"]).groupBy("name1", "name2").agg(F.sum("_n").alias("n_docs"))


def mention_edges(articles: DataFrame, url: str = "url", names: str = "politicians") -> DataFrame:
    """PUBLISHED_ABOUT: one row per article and name."""
    return (
        articles.select(F.col(url).alias("url"), F.explode(names).alias("name")).distinct()
    )


def together_edges(articles: DataFrame, names: str = "politicians") -> DataFrame:
    """MENTIONED_TOGETHER: one directed row per unordered pair, smaller name first."""
    return co_mentions(articles, names).select("name1", "name2")
