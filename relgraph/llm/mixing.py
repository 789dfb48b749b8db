"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.llm import native

BLOCK = 64
MOST = 3


def source_targets(sizes: DataFrame, share: float = 1.0, most: int = MOST) -> DataFrame:
    """source, source_size, target of every source; sizes: source, size.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share ``share``
    of all sizes by weight. A target stops at ``most`` times its source's size; the excess is
    dealt again by weight until none is above. That end is reached in one step: with the
    sources in order of size per weight, all up to some place are at their limit, and the
    others hold the rest by weight. The level of the rest grows as long as the next source
    stays below it and falls afterwards, so it is the largest of the levels. One row per source is ordered here, never documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = by_source.withColumn("weight", (F.pmod(rank - 1, F.lit(3)) + 1).cast("double"))
    limit = F.lit(most) * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    full = weighed.withColumns(
        {
            "_before": F.coalesce(F.sum(limit).over(upto), F.lit(0)).cast("double"),
            "_light": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
            "_all": F.sum("source_size").over(whole) * F.lit(float(share)),
            "_weights": F.sum("weight").over(whole),
        }
    )
    level = (F.col("_all") - F.col("_before")) / (F.col("_weights") - F.col("_light"))
    return full.withColumn("_level", F.max(level).over(whole)).select(
        "source",
        "source_size",
        F.least(limit.cast("double"), F.col("_level") * F.col("weight")).alias("target"),
    )


def _fold(units: Column, seed: int, level: int) -> Column:
    """Sequential pivotal step over one block's units (``p`` in (0, 1), ``k`` a number).

    One unit is carried. It meets the next: below 1 together, one of them takes the whole
    mass and the other gets 0; otherwise one of them gets 1 and the other the rest. The
    draws keep every unit's expectation at its p. Returns the carried unit's index and mass
    and the decided ones' indexes with their bit.
    """
    draw = lambda a, b: native.uniform(seed, F.lit(level), a["k"], b["k"])
    first = F.struct(
        F.lit(0).alias("at"),
        units[0]["p"].alias("p"),
        F.array().cast("array<struct<at:int,bit:int>>").alias("done"),
    )

    def meet(acc: Column, i: Column) -> Column:
        kept, new = units[acc["at"]], units[i]
        total = acc["p"] + new["p"]
        u = draw(kept, new)
        # the chance that the new unit is the one that goes on
        goes_on = F.when(total < 1, u * total < new["p"]).otherwise(u * (2 - total) < 1 - new["p"])
        bit = F.when(total < 1, 0).otherwise(1)
        left = F.when(total < 1, total).otherwise(total - 1)
        return F.struct(
            F.when(goes_on, i).otherwise(acc["at"]).alias("at"),
            left.alias("p"),
            F.concat(
                acc["done"],
                F.array(F.struct(F.when(goes_on, acc["at"]).otherwise(i).alias("at"), bit.alias("bit"))),
            ).alias("done"),
        )

    later = F.when(F.size(units) > 1, F.sequence(F.lit(1), F.size(units) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(later, first, meet)


def pivotal(units: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """A bit for every unit, so that each stratum's bits add up to its p within one.

    units: ``stratum``, ``size``, ``p`` in (0, 1), ``k`` (a number of its own), ``row`` (what
    to carry). Units of like size are put in blocks of about ``block``; every block is folded
    in one row and leaves one unit with its remaining mass. These form the next level's
    blocks, until a stratum has one block, whose last unit is drawn by itself. A level has
    ``block`` times fewer rows than the one before, and a hot stratum has many blocks.
    """
    result = None
    level = 0
    # the band of like sizes, at most some 8 * 64 per stratum; the whole stratum at the end
    band = F.when(F.col("size") > 0, F.floor(F.log2("size") * 8)).otherwise(F.lit(-1))
    rows = units.withColumn("band", band.cast("int"))
    while True:
        counts = rows.groupBy("stratum", "band").agg(F.count("*").alias("n"))
        parts = counts.select(
            F.col("stratum").alias("_s"), F.col("band").alias("_b"), F.ceil(F.col("n") / block).alias("n_blocks")
        )
        placed = rows.join(
            parts, F.col("stratum").eqNullSafe(F.col("_s")) & F.col("band").eqNullSafe(F.col("_b"))
        ).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k"), F.col("n_blocks")))
        grouped = placed.groupBy("stratum", "band", "part").agg(
            F.sort_array(F.collect_list(F.struct("size", "k", "p", "row"))).alias("units")
        )
        folded = native.staged(grouped.withColumn("f", _fold(F.col("units"), seed, level)).select(
            "stratum", "band",
            F.col("units")[F.col("f.at")].alias("last"), F.col("f.p").alias("p"),
            F.transform("f.done", lambda d: F.struct(
                F.col("units")[d["at"]]["row"].alias("row"), d["bit"].alias("bit"))).alias("done"),
        ))
        decided = folded.select(F.inline("done"))
        result = decided if result is None else result.unionByName(decided)
        rest = folded.select(
            "stratum", F.col("last.size").alias("size"), F.col("p"), F.col("last.k").alias("k"),
            F.col("last.row").alias("row"), F.lit(0).alias("band"),
        )
        several = rest.groupBy("stratum").agg(F.count("*").alias("n")).where("n > 1")
        # rounding of sums may leave a mass of 0 or 1, which the draw then settles for sure
        if several.isEmpty():
            last = rest.select("row", (native.uniform(seed, F.lit("last"), F.col("k")) < F.col("p")).cast("int").alias("bit"))
            return result.unionByName(last)
        rows, level = rest, level + 1


def mix(
    docs: DataFrame, share: float = 1.0, most: int = MOST, seed: int = 20260, keep: list[str] | None = None
) -> DataFrame:
    """How often the mix takes every document: one row for each row of ``docs``.

    docs: doc_id, text, source; ``keep`` names further columns to carry, others are not read.
    The size is the number of words of the text, 0 for null or empty. A source's documents
    are all taken target / source_size times on average: the whole part each, and one more
    for those that pivotal rounding picks among documents of like size. Sources of size 0
    have target 0 and are not taken. Null is a source of its own. Equal rows are placed by
    their number among their equals, so draws are the same on every run. An empty table gives no rows.
    """
    keep = keep or []
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    sized = native.staged(
        docs.select(
            "doc_id",
            "source",
            F.size(native.words(F.col("text"))).cast("long").alias("size"),
            F.xxhash64("text").alias("text_hash"),
            carried.alias("carried"),
        )
    )
    targets = source_targets(sized.select("source", "size"), share, most)
    few = targets.select(F.col("source").alias("_source"), "source_size", "target")
    twins = Window.partitionBy("doc_id", "source", "size", "text_hash").orderBy(F.lit(0))
    rated = (
        sized.join(few, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
        .withColumn("twin", F.row_number().over(twins))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "carried"]
    units = rated.select(
        F.col("source").alias("stratum"), "size", "p",
        F.xxhash64("doc_id", "source", "size", "text_hash", "twin").alias("k"),
        F.struct(*columns).alias("row"),
    )
    bits = pivotal(units.where("p > 0"), seed)
    fixed = units.where("p = 0").select("row", F.lit(0).alias("bit"))
    copies = F.col("row.whole") + F.col("bit")
    return fixed.unionByName(bits).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.size").alias("size"),
        F.col("row.source_size").alias("source_size"),
        F.col("row.target").alias("target"),
        (copies * F.col("row.size")).cast("long").alias("taken"),
        copies.alias("copies"),
        F.col("row.source").alias("source"),
        *([F.col("row.carried").alias("carried")] if keep else []),
    )


def mixed(docs: DataFrame, share: float = 1.0, most: int = MOST, seed: int = 20260) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns are kept, whatever their names.

    Copies are worked out on slim rows and meet the texts once, by id, source and a hash of the
    text. Rows that are equal in all three share what the mix takes of them evenly, the first
    of them (by their other columns) one more where it doesn't divide, so each keeps its own
    columns. Null ids, texts and sources are values of their own; an empty table gives no rows.
    """
    slim = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    copies = mix(slim, share, most, seed, keep=["text_hash"])
    by_key = native.staged(
        copies.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("carried.text_hash").alias("hash")).agg(
            F.sum("copies").alias("copies"), F.count("*").alias("rows")
        )
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64("text").alias("text_hash"))
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("from")) & (F.col("text_hash") == F.col("hash"))
    )
    met = keyed.join(by_key.where("copies > 0"), same)
    single = met.where("rows = 1").select("row", "copies")
    if not by_key.where("rows > 1 and copies > 0").isEmpty():
        order = Window.partitionBy("id", "from", "hash").orderBy(*[F.hash(F.col("row").getField(c)) for c in docs.columns])
        place = met.where("rows > 1").withColumn("place", F.row_number().over(order))
        even = F.floor(F.col("copies") / F.col("rows"))
        one_more = F.when(F.col("place") <= F.col("copies") - even * F.col("rows"), 1).otherwise(0)
        single = single.unionByName(place.select("row", (even + one_more).alias("copies")).where("copies > 0"))
    repeated = single.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
