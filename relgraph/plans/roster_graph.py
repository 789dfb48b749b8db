"""From a roster to the member graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.functions import roster
from relgraph.functions.roster import or_blank, present
from relgraph.operators import groups, tables
from relgraph.operators.relations import family_edges, person_nodes
from relgraph.session import cut
from relgraph.sources.writers import write_graph


@dataclass
class Graph:
    """Stored nodes and edges, and the key sets that stand for the group relations."""

    nodes: DataFrame
    edges: DataFrame
    sets: DataFrame | None = None


    def stored(self, path: str) -> Graph:
        """Written below ``path`` and read back, for the queries that walk it.

        Edges and key sets are laid out by type, so a walk over some types opens
        only their files.
        """
        spark = self.nodes.sparkSession
        write_graph(self.nodes, self.edges, path)
        sets = None
        if self.sets is not None:
            self.sets.write.mode("overwrite").partitionBy("etype").parquet(f"{path}/sets")
            sets = spark.read.schema(self.sets.schema).parquet(f"{path}/sets")
        return Graph(
            spark.read.schema(self.nodes.schema).parquet(f"{path}/nodes"),
            spark.read.schema(self.edges.schema).parquet(f"{path}/edges"),
            sets,
        )


def member_names(nodes: DataFrame) -> DataFrame:
    """``(id, name)`` of the member nodes, for searches."""
    return nodes.where(F.array_contains("labels", "Member")).select(
        F.col("key").alias("id"), F.col("props")["name"].alias("name")
    )


def parsed(rows: DataFrame) -> DataFrame:
    """Roster rows with id, sido, district, count and terms taken from their texts."""
    return rows.select(
        "*",
        roster.id_from_link(F.col("detail_link")).alias("id"),
        roster.sido_of(F.col("region")).alias("sido"),
        roster.district_of(F.col("region")).alias("district"),
        roster.election_count(F.col("election_text")).alias("election_count"),
        roster.terms(F.col("election_text")).alias("terms"),
    )


def valid_members(rows: DataFrame) -> DataFrame:
    return rows.where(present(F.col("id")) & present(F.col("name")))


def parties(rows: DataFrame) -> DataFrame:
    return rows.where(present(F.col("party"))).select("party").distinct()


def regions(rows: DataFrame) -> DataFrame:
    """``(sido, region)`` of every row with a district, valid member or not."""
    return rows.where(present(F.col("district"))).select("sido", F.col("district").alias("region")).distinct()


def containment(region_rows: DataFrame) -> DataFrame:
    """CONTAINS pairs; a district named under two sidos has both as parents."""
    return region_rows.where(present(F.col("sido"))).select("sido", "region").distinct()


def members(rows: DataFrame) -> DataFrame:
    """One row per id, the last record wins as a whole."""
    texts = ["committee", "phone", "email", "office", "homepage", "photo_url", "photo_filename", "detail_link"]
    picked = valid_members(rows).select(
        "id",
        "name",
        or_blank(F.col("party")).alias("party"),
        F.col("district").alias("region"),
        "sido",
        or_blank(F.col("region")).alias("region_detail"),
        "election_count",
        "terms",
        *tables.filled(texts),
        "ordinal",
    )
    return tables.latest_rows(picked, ["id"], ["ordinal"]).drop("ordinal")


def schools(rows: DataFrame) -> DataFrame:
    """``(id, school)`` from career lines; the member need not have a valid record otherwise."""
    usable = rows.where(present(F.col("id")) & present(F.col("name")) & F.col("careers").isNotNull())
    return (
        usable.select("id", F.explode("careers").alias("line"))
        .select("id", roster.school_of(F.col("line")).alias("school"))
        .where(F.col("school").isNotNull())
        .distinct()
    )


def belongs(rows: DataFrame) -> DataFrame:
    """``(id, party)`` of all records of a member, also of earlier ones."""
    return valid_members(rows).where(present(F.col("party"))).select("id", "party").distinct()


def represents(rows: DataFrame) -> DataFrame:
    return (
        valid_members(rows)
        .where(present(F.col("district")))
        .select("id", F.col("district").alias("region"))
        .distinct()
    )


def region_nodes(region_rows: DataFrame) -> DataFrame:
    districts = region_rows.groupBy("region").agg(F.min("sido").alias("sido"))
    sidos = region_rows.where(present(F.col("sido"))).select("sido").distinct()
    return tables.nodes(
        districts, ["Region"], tables.region_id("region", F.col("region")), F.col("region"),
        {"name": F.col("region"), "type": F.lit("region"), "sido": F.col("sido")},
    ).unionByName(
        tables.nodes(
            sidos, ["Region", "Sido"], tables.region_id("sido", F.col("sido")), F.col("sido"),
            {"name": F.col("sido"), "type": F.lit("sido")},
        )
    )


def region_edges(contains: DataFrame) -> DataFrame:
    return tables.edges(
        contains, tables.region_id("sido", F.col("sido")), tables.region_id("region", F.col("region")), "CONTAINS"
    )


def named_node(df: DataFrame, label: str, column: str) -> DataFrame:
    return tables.nodes(
        df.select(column).distinct(), [label], tables.node_id(label, F.col(column)), F.col(column),
        {"name": F.col(column)},
    )


def represents_edges(rep: DataFrame, contains: DataFrame) -> DataFrame:
    """A member is tied to every region node of the name, district or sido."""
    sidos = contains.select(F.col("sido").alias("region")).distinct()
    member = tables.node_id("Member", F.col("id"))
    return tables.edges(
        rep, member, tables.region_id("region", F.col("region")), "REPRESENTS"
    ).unionByName(
        tables.edges(
            rep.join(sidos, "region"), member, tables.region_id("sido", F.col("region")), "REPRESENTS"
        )
    )


def group_sets(member_rows: DataFrame, bel: DataFrame, rep: DataFrame, contains: DataFrame,
               school_rows: DataFrame, region_mode: str = "literal") -> DataFrame:
    """Key sets of all four group relations, ids as node ids."""
    terms = member_rows.select("id", F.explode("terms").alias("term"))
    sets = groups.union_sets(
        [
            groups.key_sets(bel, "SAME_PARTY", "id", "party"),
            groups.region_key_sets(rep, contains, member_rows, region_mode),
            groups.key_sets(terms, "SAME_TERM", "id", "term"),
            groups.key_sets(school_rows, "SAME_SCHOOL", "id", "school"),
        ]
    )
    return sets.withColumn("id", tables.node_id("Member", F.col("id")))


def roster_graph(rows: DataFrame, region_mode: str = "literal") -> Graph:
    """Nodes, base edges and group relations of a roster.

    Invalid records still add their party and region. Edges exist only between
    existing nodes; the derived relations stay folded (`relgraph.operators.groups`).
    """
    # every node and edge family below reads the parsed rows
    rows = cut(parsed(rows), "roster")
    people = members(rows)
    region_rows = regions(rows)
    contains = containment(region_rows)
    bel, rep = belongs(rows), represents(rows)
    taught = schools(rows).join(people.select("id"), "id", "left_semi")
    ident = tables.node_id("Member", F.col("id"))
    props: dict[str, Column] = {c: F.col(c) for c in people.columns}
    props["terms"] = F.array_join("terms", ",")
    nodes = (
        tables.nodes(people, ["Member"], ident, F.col("id"), props)
        .unionByName(named_node(parties(rows), "Party", "party"))
        .unionByName(region_nodes(region_rows))
        .unionByName(named_node(schools(rows), "School", "school"))
    )
    edges = (
        tables.edges(bel, ident, tables.node_id("Party", F.col("party")), "BELONGS_TO")
        .unionByName(represents_edges(rep, contains))
        .unionByName(region_edges(contains))
        .unionByName(tables.edges(taught, ident, tables.node_id("School", F.col("school")), "GRADUATED_FROM"))
    )
    sets = group_sets(people, bel, rep, contains, taught, region_mode)
    return Graph(nodes, edges, sets)


def code_only_members(rows: DataFrame) -> DataFrame:
    """Member nodes keyed by code alone; records without a code share the key ``''``."""
    fields = ["name", "party", "photo_url", "photo_filename", "unit", "committee", "region", "gender",
              "election_text", "election_method"]
    picked = rows.select(or_blank(F.col("mona_code")).alias("mona_code"), *tables.filled(fields), "ordinal")
    return tables.latest_rows(picked, ["mona_code"], ["ordinal"]).drop("ordinal")


def family_graph(persons: DataFrame) -> Graph:
    """Person nodes with SPOUSE and FAMILY edges."""
    kin = family_edges(persons)
    people = person_nodes(persons, kin)
    nodes = tables.nodes(
        people, ["Person"], tables.node_id("Person", F.col("name")), F.col("name"),
        {c: F.col(c) for c in ("name", "wiki_url", "birth_place", "party")},
    )
    edges = tables.edges(
        kin, tables.node_id("Person", F.col("src")), tables.node_id("Person", F.col("dst")), F.col("type")
    )
    return Graph(nodes, edges)
