"""Relations between people who share a group: party, region, term, school.

Everyone in a group is related to everyone else in it, so the relation of one
group of n people has n(n-1) directed edges. It is therefore kept as the sets of
keys each person holds, one row per person, from which follow exactly

* how many people each person is related to (`related_counts`),
* how many edges there are (the sum of these counts), and
* the edges of chosen people (`edges_from`),

none of which lists all pairs of a group.

``probe`` holds the keys a person looks for, ``build`` the keys a person is found
by; two people are related when one's probe keys meet the other's build keys. For
plain groups the two are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.session import cut
from relgraph.skew import lookup_join, salted_join

MAX_SUBSET_KEYS = 6
"""Key sets of up to so many keys are counted over their subsets (63 rows at most), larger ones in bitmaps."""

BITS = 32_768
"""Positions of one bitmap of bitmap_construct_agg."""


def key_sets(pairs: DataFrame, etype: str, member: str, key: str) -> DataFrame:
    """``(etype, id, probe, build)`` from rows of member and group key.

    Any number of people may hold a key; one person holds few keys, and repeated
    rows of a person are folded before they are gathered.
    """
    keys = (
        pairs.where(F.col(member).isNotNull() & F.col(key).isNotNull())
        .select(F.col(member).alias("id"), F.col(key).cast("string").alias("key"))
        .distinct()
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("key")).alias("probe"))
    )
    return keys.select(F.lit(etype).alias("etype"), "id", "probe", F.col("probe").alias("build"))


def region_key_sets(
    represents: DataFrame, contains: DataFrame, members: DataFrame, mode: str = "literal"
) -> DataFrame:
    """Key sets of SAME_REGION.

    ``represents(id, region)``, ``contains(sido, region)``, ``members(id, sido)``.
    ``literal`` relates members of one district, or of a district and the region
    node above or below it; ``same_sido`` relates all members of one sido. Members
    without sido are never related.
    """
    placed = members.where(F.col("sido").isNotNull()).select("id", "sido")
    if mode == "same_sido":
        return key_sets(placed, "SAME_REGION", "id", "sido")
    if mode != "literal":
        raise ValueError(f"unknown mode {mode!r}")
    rep = represents.join(placed, "id").select("id", F.col("sido").alias("own"), "region").distinct()

    def node(kind: str, name: Column) -> Column:
        return F.concat_ws("|", F.col("own"), F.lit(kind), name)

    # a region name may stand for a district node and for a sido node
    sidos = contains.select(F.col("sido").alias("region")).distinct()
    as_district = rep.select("id", node("region", F.col("region")).alias("key"))
    as_sido = rep.join(sidos, "region").select("id", node("sido", F.col("region")).alias("key"))
    up = rep.join(contains, "region").select("id", node("sido", F.col("sido")).alias("key"))
    # only districts below a represented sido node: the join starts at `rep`
    down = rep.join(
        contains.select(F.col("sido").alias("region"), F.col("region").alias("below")), "region"
    ).select("id", node("region", F.col("below")).alias("key"))
    build = as_district.unionByName(as_sido).withColumn("found_by", F.lit(True))
    probe = up.unionByName(down).withColumn("found_by", F.lit(False))
    keys = build.unionByName(probe).groupBy("id", "key").agg(F.max("found_by").alias("found_by"))
    sets = keys.groupBy("id").agg(
        F.sort_array(F.collect_list("key")).alias("probe"),
        F.sort_array(F.collect_list(F.when(F.col("found_by"), F.col("key")))).alias("build"),
    )
    return sets.select(F.lit("SAME_REGION").alias("etype"), "id", "probe", "build")


def _subsets(keys: Column) -> Column:
    """All non-empty subsets of a sorted array."""
    grown = F.aggregate(
        keys,
        F.array(F.array().cast("array<string>")),
        lambda acc, k: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(k)))),
    )
    return F.filter(grown, lambda s: F.size(s) > 0)


def related_counts(sets: DataFrame) -> DataFrame:
    """``(etype, id, n)``: to how many other people each person is related.

    People with equal key sets are folded first. For a set P of probe keys the
    union of its groups is counted by inclusion and exclusion over the subsets of
    P; the number of people holding a whole subset is one grouped count. That is
    linear in the people. A set of more than MAX_SUBSET_KEYS keys has too many subsets;
    where such a set asks or is asked for, unions are counted in bitmaps instead. The ways
    count disjoint parts of the same people, and neither forms pairs of people or sets.
    """
    sets = cut(sets.withColumn("sig", F.to_json(F.struct("etype", "probe", "build"))), "sets")
    folded = cut(sets.groupBy("sig", "etype", "probe", "build").agg(F.count("*").alias("people")))
    narrow_probe, narrow_build = (F.size(c) <= MAX_SUBSET_KEYS for c in ("probe", "build"))
    counted = (
        _by_subsets(folded.where(narrow_probe), folded.where(narrow_build))
        .unionByName(_by_bitmaps(folded.where(narrow_probe), folded.where(~narrow_build)))
        .unionByName(_by_bitmaps(folded.where(~narrow_probe), folded))
        .groupBy("sig")
        .agg(F.sum("n").alias("n"))
    )
    sized = counted.join(folded.select("sig", "people"), "sig")
    # n counts the person too, who always finds themself
    answers = cut(sized.select("sig", "people", (F.col("n") - 1).alias("n")))
    return lookup_join(sets.select("etype", "id", "sig"), answers, "sig", "people").select(
        "etype", "id", "n"
    )


def _by_subsets(asking: DataFrame, found: DataFrame) -> DataFrame:
    holders = (
        found.select("etype", F.explode(_subsets(F.col("build"))).alias("sub"), "people")
        .groupBy("etype", "sub")
        .agg(F.sum("people").alias("holders"))
    )
    asked = asking.select("sig", "etype", F.explode(_subsets(F.col("probe"))).alias("sub"))
    sign = F.when(F.size("sub") % 2 == 1, F.col("holders")).otherwise(-F.col("holders"))
    return asked.join(holders, ["etype", "sub"]).groupBy("sig").agg(F.sum(sign).alias("n"))


def _by_bitmaps(asking: DataFrame, others: DataFrame) -> DataFrame:
    """(sig, n): people of ``others`` who hold one of the keys that a set asks for.

    Sets of keys are numbered in parts of a few thousand, and each key has a bitmap of the sets
    that hold it for every part it occurs in; the union over the asked keys is an OR. A set
    stands for ``people`` people: it is in the bitmaps of the binary digits of that number, and
    the bits of digit d count 2**d each.
    """
    parts = -(-others.count() // (BITS // 2)) or 1
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda d: F.call_function("getbit", F.col("people"), d) == 1)
    each = others.select("etype", "sig", "build", F.pmod(F.xxhash64("sig"), F.lit(parts)).alias("part"), F.explode(digits).alias("digit"))
    order = Window.partitionBy("etype", "part", "digit").orderBy("sig")
    numbered = each.withColumn("place", F.row_number().over(order) - 1)
    at = ["part", "digit", F.floor(F.col("place") / BITS).alias("more")]
    held = (
        numbered.select("etype", F.explode("build").alias("key"), *at, (F.col("place") % BITS).cast("long").alias("place"))
        .groupBy("etype", "key", "part", "digit", "more")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )
    asked = asking.select("sig", "etype", F.explode("probe").alias("key"))
    met = asked.join(held, ["etype", "key"]).groupBy("sig", "part", "digit", "more").agg(F.bitmap_or_agg("bits").alias("bits"))
    people = F.bitmap_count("bits") * F.pow(F.lit(2.0), F.col("digit")).cast("long")
    return met.groupBy("sig").agg(F.sum(people).alias("n"))


def edges_from(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(src, dst, etype)``: all group edges that start at the chosen ids.

    The output is linear in the groups of the chosen people. Large groups are
    spread over many tasks.
    """
    asked = (
        sets.join(chosen.select("id").distinct(), "id", "left_semi")
        .select("etype", F.col("id").alias("src"), F.explode("probe").alias("key"))
    )
    found = sets.select("etype", F.col("id").alias("dst"), F.explode("build").alias("key"))
    return (
        salted_join(asked, found, ["etype", "key"], ["dst"])
        .where(F.col("src") != F.col("dst"))
        .select("src", "dst", "etype")
        .distinct()
    )


def union_sets(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
