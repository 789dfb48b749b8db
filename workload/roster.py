"""Customers as members: roster texts are built from the tables, then parsed and linked.

Mapping: party = market segment, region text = region and nation, election text =
years with orders as terms, career lines = order priorities. Negative balances are
proportional seats, balances from 9900 have an unusable link, and balances between
9000 and 9500 appear a second time under another party.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relgraph.functions import roster as fields
from relgraph.operators import groups, paths, relations, search, tables
from relgraph.plans import roster_graph
from relgraph.schemas import ROSTER
from relgraph.session import scratch_path
from relgraph.sources import readers, writers
from workload.base import query, table

LINK = "https://members.example.org/22nd/"
QUERY = "99"

SCHOOL_LINES = {
    "1-URGENT": "가나대학교 법학과 졸업",
    "2-HIGH": "다라대학교대학원 수료",
    "3-MEDIUM": "마바대학 졸업",
    "4-NOT SPECIFIED": "변호사",
    "5-LOW": "대학원 졸업",
}
SCHOOL_NAMES = {"1-URGENT": "가나대학교", "2-HIGH": "다라대학교대학", "3-MEDIUM": "마바대학"}

PEOPLE = f"""
base AS (
  SELECT c_custkey, c_name, c_mktsegment, c_acctbal, replace(r_name, ' ', '_') AS r_name, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
records AS (
  SELECT c_custkey AS ordinal, c_custkey, c_name AS name, c_mktsegment AS party,
    CASE WHEN c_acctbal >= 9900 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS id,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE r_name END AS sido,
    CASE WHEN c_acctbal < 0 THEN '비례대표' ELSE n_name END AS district FROM base
  UNION ALL
  SELECT 1000000000000 + c_custkey, c_custkey, c_name, 'MOVED', CAST(c_custkey AS VARCHAR), r_name, n_name
  FROM base WHERE c_acctbal BETWEEN 9000 AND 9500),
members AS (
  SELECT id, arg_max(name, ordinal) AS name, arg_max(party, ordinal) AS party, any_value(c_custkey) AS c_custkey,
    any_value(sido) AS sido, any_value(district) AS district
  FROM records WHERE id IS NOT NULL GROUP BY id),
years AS (SELECT DISTINCT o_custkey, year(o_orderdate) - 1980 AS term FROM orders),
elections AS (SELECT o_custkey, count(*) AS n_terms, string_agg(term, ',' ORDER BY term) AS terms FROM years GROUP BY 1),
belongs AS (SELECT DISTINCT id, party FROM records WHERE id IS NOT NULL),
represents AS (SELECT DISTINCT id, district FROM records WHERE id IS NOT NULL),
regions AS (SELECT DISTINCT sido, district FROM records),
school_map(priority, school) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SCHOOL_NAMES.items())}),
graduated AS (
  SELECT DISTINCT m.id, s.school FROM members m JOIN orders o ON o.o_custkey = m.c_custkey
  JOIN school_map s ON s.priority = o.o_orderpriority)
"""

# every unordered brute-force relation, for comparison only
SAME = """
same_party AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM belongs a JOIN belongs b ON a.party = b.party AND a.id <> b.id),
same_region AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM members a JOIN members b
                ON a.district = b.district AND a.sido = b.sido AND a.id <> b.id),
same_sido AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM members a JOIN members b ON a.sido = b.sido AND a.id <> b.id),
member_terms AS (SELECT id, term FROM members JOIN years ON o_custkey = c_custkey),
same_term AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM member_terms a JOIN member_terms b
              ON a.term = b.term AND a.id <> b.id),
same_school AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM graduated a JOIN graduated b
                ON a.school = b.school AND a.id <> b.id)
"""


def roster_rows(spark, sf_dir) -> DataFrame:
    """Roster records in the shape the readers deliver."""
    regions = table(spark, sf_dir, "region").withColumn("r_name", F.replace("r_name", F.lit(" "), F.lit("_")))
    places = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.create_map(*[F.lit(x) for pair in SCHOOL_LINES.items() for x in pair])
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        (F.year("o_orderdate") - 1980).alias("term"),
        line[F.col("o_orderpriority")].alias("line"),
    )
    # few distinct terms and lines per customer, so the sets stay short however many orders there are
    past = orders.groupBy("c_custkey").agg(
        F.sort_array(F.collect_set("term")).alias("terms"), F.sort_array(F.collect_set("line")).alias("careers")
    )
    seats = F.array_join(
        F.transform("terms", lambda t: F.concat(F.lit("제"), t.cast("string"), F.lit("대"))), ", "
    )
    people = (
        table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(past, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("ordinal"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("party"),
            F.when(F.col("c_acctbal") < 0, fields.PROPORTIONAL)
            .otherwise(F.concat_ws(" ", "r_name", "n_name"))
            .alias("선거구"),
            F.concat(F.size("terms").cast("string"), F.lit("선("), seats, F.lit(")")).alias("당선횟수"),
            F.concat(
                F.lit(LINK), F.when(F.col("c_acctbal") < 9900, F.col("c_custkey").cast("string")).otherwise("")
            ).alias("detail_link"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string")).alias("monaCd"),
            F.col("careers").alias("약력"),
            "c_acctbal",
        )
    )
    again = people.where(F.col("c_acctbal").between(9000, 9500)).withColumn("party", F.lit("MOVED"))
    again = again.withColumn("ordinal", F.col("ordinal") + F.lit(1000000000000))
    rows = people.unionByName(again)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ROSTER.fields if f.name not in rows.columns}
    return readers.normal_roster(rows.withColumns(missing))


def graph_of(spark, sf_dir, region_mode="literal") -> roster_graph.Graph:
    return roster_graph.roster_graph(roster_rows(spark, sf_dir), region_mode)


def stored_graph(spark, sf_dir, with_groups=True) -> roster_graph.Graph:
    graph = graph_of(spark, sf_dir)
    if not with_groups:
        graph.sets = None
    return graph.stored(scratch_path(spark, "graph"))


# --- parsing and base graph -----------------------------------------------------------


@query(
    f"""WITH {PEOPLE} SELECT m.id, m.name, m.party, coalesce(m.sido, '') AS sido, m.district AS region,
      coalesce(e.n_terms, 0) AS election_count, coalesce(e.terms, '') AS terms
    FROM members m LEFT JOIN elections e ON e.o_custkey = m.c_custkey"""
)
def member_nodes(spark, sf_dir):
    rows = roster_graph.parsed(roster_rows(spark, sf_dir))
    return roster_graph.members(rows).select(
        "id",
        "name",
        "party",
        fields.or_blank(F.col("sido")).alias("sido"),
        "region",
        "election_count",
        F.array_join("terms", ",").alias("terms"),
    )


NODES = """
nodes AS (
  SELECT 'Member:' || id AS node_id, 'Member' AS labels FROM members
  UNION ALL SELECT DISTINCT 'Party:' || party, 'Party' FROM records
  UNION ALL SELECT DISTINCT 'Region:region:' || district, 'Region' FROM regions
  UNION ALL SELECT DISTINCT 'Region:sido:' || sido, 'Region,Sido' FROM regions WHERE sido IS NOT NULL
  UNION ALL SELECT DISTINCT 'School:' || school, 'School' FROM graduated)
"""
EDGES = """
edges AS (
  SELECT 'Member:' || id AS src, 'Party:' || party AS dst, 'BELONGS_TO' AS type FROM belongs
  UNION ALL SELECT 'Member:' || id, 'Region:region:' || district, 'REPRESENTS' FROM represents
  UNION ALL SELECT DISTINCT 'Region:sido:' || sido, 'Region:region:' || district, 'CONTAINS' FROM regions WHERE sido IS NOT NULL
  UNION ALL SELECT 'Member:' || id, 'School:' || school, 'GRADUATED_FROM' FROM graduated)
"""


@query(f"WITH {PEOPLE}, {NODES} SELECT * FROM nodes")
def roster_graph_nodes(spark, sf_dir):
    return graph_of(spark, sf_dir).nodes.select("node_id", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {PEOPLE}, {EDGES} SELECT * FROM edges")
def roster_graph_edges(spark, sf_dir):
    return graph_of(spark, sf_dir).edges.select("src", "dst", "type")


@query(
    f"""WITH {PEOPLE} SELECT DISTINCT 'Member:' || c.c_custkey AS src, 'Party:' || c_mktsegment AS dst
    FROM customer c WHERE CAST(c_custkey AS VARCHAR) IN (SELECT id FROM members) AND c_mktsegment <> 'MACHINERY'"""
)
def edges_with_endpoints(spark, sf_dir):
    """Edge candidates of all customers, kept where member and party exist as nodes."""
    graph = graph_of(spark, sf_dir)
    candidates = tables.edges(
        table(spark, sf_dir, "customer"),
        tables.node_id("Member", F.col("c_custkey").cast("string")),
        tables.node_id("Party", F.col("c_mktsegment")),
        "BELONGS_TO",
    )
    parties = graph.nodes.where(F.col("node_id") != "Party:MACHINERY")
    kept = tables.with_endpoints(candidates, graph.nodes, parties)
    return tables.distinct_edges(kept).select("src", "dst")


@query(f"WITH {PEOPLE} SELECT DISTINCT party FROM records")
def party_nodes(spark, sf_dir):
    return roster_graph.parties(roster_graph.parsed(roster_rows(spark, sf_dir)))


@query(f"WITH {PEOPLE} SELECT DISTINCT sido, district AS region FROM regions WHERE sido IS NOT NULL")
def region_containment(spark, sf_dir):
    return roster_graph.containment(roster_graph.regions(roster_graph.parsed(roster_rows(spark, sf_dir))))


@query(
    f"""WITH {PEOPLE}, coded AS (SELECT coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(r.c_custkey AS VARCHAR) END, '')
        AS mona_code, r.ordinal, r.name, r.party FROM records r JOIN customer c ON c.c_custkey = r.c_custkey)
    SELECT mona_code, arg_max(name, ordinal) AS name, arg_max(party, ordinal) AS party FROM coded GROUP BY mona_code"""
)
def code_only_members(spark, sf_dir):
    return roster_graph.code_only_members(roster_rows(spark, sf_dir)).select("mona_code", "name", "party")


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def keyed_upsert(spark, sf_dir):
    """Orders of the first statuses are the stored rows, the rest a later batch."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return tables.latest_rows(orders, ["o_custkey"], ["o_orderkey"])


@query(
    """WITH stored AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    fresh AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
    pick AS (SELECT coalesce(f.o_custkey, s.o_custkey) AS o_custkey, coalesce(f.k, s.k) AS k
             FROM fresh f FULL JOIN stored s ON f.o_custkey = s.o_custkey)
    SELECT p.o_custkey, o.o_orderstatus, o.o_orderpriority FROM pick p JOIN orders o ON o.o_orderkey = p.k"""
)
def upsert_into_stored(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    stored = tables.latest_rows(orders.where(F.col("o_orderstatus") == "F"), ["o_custkey"], ["o_orderkey"])
    batch = orders.where(F.col("o_orderstatus") != "F")
    return tables.upsert(stored.drop("o_orderkey"), batch, ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark, sf_dir):
    return tables.key_violations(table(spark, sf_dir, "orders"), ["o_custkey"])


# --- group relations -------------------------------------------------------------------


def _counts_sql(relation: str, holders: str) -> str:
    return f"""WITH {PEOPLE}, {SAME}, holders AS ({holders})
    SELECT h.id, count(s.dst) AS n FROM holders h LEFT JOIN {relation} s ON s.src = h.id GROUP BY h.id"""


def _counts(spark, sf_dir, etype, region_mode="literal"):
    sets = graph_of(spark, sf_dir, region_mode).sets.where(F.col("etype") == etype)
    return groups.related_counts(sets).select(F.substring_index("id", ":", -1).alias("id"), "n")


@query(_counts_sql("same_party", "SELECT DISTINCT id FROM belongs"))
def same_party(spark, sf_dir):
    """How many SAME_PARTY edges start at each member."""
    return _counts(spark, sf_dir, "SAME_PARTY")


@query(_counts_sql("same_region", "SELECT id FROM members WHERE sido IS NOT NULL"))
def same_region_literal(spark, sf_dir):
    return _counts(spark, sf_dir, "SAME_REGION")


@query(_counts_sql("same_sido", "SELECT id FROM members WHERE sido IS NOT NULL"))
def same_region_sido(spark, sf_dir):
    return _counts(spark, sf_dir, "SAME_REGION", "same_sido")


@query(_counts_sql("same_term", "SELECT DISTINCT id FROM member_terms"))
def same_term(spark, sf_dir):
    return _counts(spark, sf_dir, "SAME_TERM")


@query(_counts_sql("same_school", "SELECT DISTINCT id FROM graduated"))
def same_school(spark, sf_dir):
    return _counts(spark, sf_dir, "SAME_SCHOOL")


@query(
    f"""WITH {PEOPLE}, {SAME}, {NODES}, {EDGES}
    SELECT 'node' AS kind, l.name, (SELECT count(*) FROM nodes n WHERE list_contains(string_split(n.labels, ','), l.name)) AS n
    FROM (SELECT unnest(['Member', 'Party', 'Region', 'School']) AS name) l
    UNION ALL SELECT 'edge', t.name, (SELECT count(*) FROM edges e WHERE e.type = t.name)
    FROM (SELECT unnest(['BELONGS_TO', 'REPRESENTS', 'GRADUATED_FROM']) AS name) t
    UNION ALL SELECT 'edge', 'SAME_PARTY', count(*) FROM same_party
    UNION ALL SELECT 'edge', 'SAME_REGION', count(*) FROM same_region
    UNION ALL SELECT 'edge', 'SAME_TERM', count(*) FROM same_term
    UNION ALL SELECT 'edge', 'SAME_SCHOOL', count(*) FROM same_school"""
)
def graph_stats(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return tables.statistics(graph.nodes, graph.edges, groups.related_counts(graph.sets))


# --- search and paths --------------------------------------------------------------------

FIRST = f"""hit AS (SELECT id FROM members WHERE contains(name, '{QUERY}') ORDER BY name, id LIMIT 1)"""


@query(
    f"""WITH {PEOPLE} SELECT m.name, m.id, b.party, r.district AS region, coalesce(e.n_terms, 0) AS election_count
    FROM members m LEFT JOIN belongs b ON b.id = m.id LEFT JOIN represents r ON r.id = m.id
    LEFT JOIN elections e ON e.o_custkey = m.c_custkey WHERE contains(m.name, '{QUERY}')"""
)
def member_search(spark, sf_dir):
    rows = roster_graph.parsed(roster_rows(spark, sf_dir))
    return search.member_search(
        roster_graph.members(rows), roster_graph.belongs(rows), roster_graph.represents(rows), QUERY
    )


@query(
    f"""WITH {PEOPLE}, {SAME}, {FIRST}
    SELECT src, dst, 'SAME_PARTY' AS etype FROM same_party WHERE src IN (SELECT id FROM hit)
    UNION ALL SELECT src, dst, 'SAME_REGION' FROM same_region WHERE src IN (SELECT id FROM hit)
    UNION ALL SELECT src, dst, 'SAME_TERM' FROM same_term WHERE src IN (SELECT id FROM hit)
    UNION ALL SELECT src, dst, 'SAME_SCHOOL' FROM same_school WHERE src IN (SELECT id FROM hit)"""
)
def group_edges_of_match(spark, sf_dir):
    """All group edges of the member that a name search finds."""
    graph = stored_graph(spark, sf_dir)
    found = search.first_match(roster_graph.member_names(graph.nodes), QUERY)
    chosen = found.select(F.concat(F.lit("Member:"), "id").alias("id"))
    out = groups.edges_from(graph.sets, chosen)
    return out.select(
        F.substring_index("src", ":", -1).alias("src"), F.substring_index("dst", ":", -1).alias("dst"), "etype"
    )


BOTH_WAYS = """
ways AS (
  SELECT src AS tip, dst AS next, src || '|' || type || '|' || dst AS edge FROM edges
  UNION ALL SELECT dst, src, src || '|' || type || '|' || dst FROM edges WHERE src <> dst),
"""
TRAILS = f"""{BOTH_WAYS}
one AS (SELECT 'Member:' || h.id AS start, w.next AS tip, [w.edge] AS used, ['Member:' || h.id, w.next] AS seen
        FROM hit h JOIN ways w ON w.tip = 'Member:' || h.id),
two AS (SELECT o.start, w.next AS tip, list_append(o.used, w.edge) AS used, list_append(o.seen, w.next) AS seen
        FROM one o JOIN ways w ON w.tip = o.tip WHERE NOT list_contains(o.used, w.edge)),
trails AS (SELECT 1 AS depth, array_to_string(used, ';') AS path_key, seen, used FROM one
           UNION ALL SELECT 2, array_to_string(used, ';'), seen, used FROM two),
listed AS (SELECT * FROM trails ORDER BY depth, path_key LIMIT 100)
"""


def _match_paths(spark, sf_dir, depth=2, with_groups=False):
    graph = stored_graph(spark, sf_dir, with_groups)
    found = paths.named_neighbourhood(
        roster_graph.member_names(graph.nodes), graph.nodes, graph.edges, QUERY, depth, limit=100, sets=graph.sets
    )
    return graph, found


@query(f"WITH {PEOPLE}, {EDGES}, {FIRST}, {TRAILS} SELECT depth, path_key FROM listed")
def khop_neighbourhood(spark, sf_dir):
    return _match_paths(spark, sf_dir)[1].select("depth", "path_key")


@query(f"WITH {PEOPLE}, {EDGES}, {FIRST}, {TRAILS} SELECT DISTINCT unnest(seen) AS node_id FROM listed")
def khop_nodes(spark, sf_dir):
    graph, found = _match_paths(spark, sf_dir)
    return paths.subgraph_nodes(found, graph.nodes).select("node_id")


@query(
    f"""WITH {PEOPLE}, {EDGES}, {FIRST}, {TRAILS}, parts AS (SELECT unnest(used) AS e FROM listed)
    SELECT split_part(e, '|', 1) AS src, split_part(e, '|', 3) AS dst, split_part(e, '|', 2) AS type, count(*) AS n
    FROM parts GROUP BY ALL"""
)
def khop_relationships(spark, sf_dir):
    """Relationships once per path they lie on."""
    graph, found = _match_paths(spark, sf_dir)
    listed = paths.subgraph_edges(found, graph.edges)
    return listed.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {PEOPLE}, {EDGES}, {FIRST}, {TRAILS}
    SELECT (SELECT count(DISTINCT s) FROM (SELECT unnest(seen) AS s FROM listed)) AS nodes,
           (SELECT sum(len(used))::BIGINT FROM listed) AS relationships"""
)
def subgraph_json(spark, sf_dir):
    """The JSON form of the result, read back and counted."""
    graph, found = _match_paths(spark, sf_dir)
    text = paths.subgraph_json(paths.subgraph_nodes(found, graph.nodes), paths.subgraph_edges(found, graph.edges))
    shape = "nodes array<struct<id:string>>, relationships array<struct<start:string>>"
    parsed = text.select(F.from_json("json", shape).alias("j"))
    return parsed.select(
        F.size("j.nodes").cast("long").alias("nodes"), F.size("j.relationships").cast("long").alias("relationships")
    )


GROUP_EDGES = """
group_edges AS (
  SELECT 'Member:' || src AS src, 'Member:' || dst AS dst, 'SAME_PARTY' AS type FROM same_party
  UNION ALL SELECT 'Member:' || src, 'Member:' || dst, 'SAME_REGION' FROM same_region
  UNION ALL SELECT 'Member:' || src, 'Member:' || dst, 'SAME_TERM' FROM same_term
  UNION ALL SELECT 'Member:' || src, 'Member:' || dst, 'SAME_SCHOOL' FROM same_school)
"""


@query(
    f"""WITH {PEOPLE}, {SAME}, {EDGES}, {GROUP_EDGES}, {FIRST}, start AS (SELECT 'Member:' || id AS s FROM hit),
    both_kinds AS (SELECT * FROM edges UNION ALL SELECT * FROM group_edges),
    hits AS (SELECT src || '|' || type || '|' || dst AS path_key FROM both_kinds, start
             WHERE src = s OR dst = s)
    SELECT 1 AS depth, path_key FROM hits ORDER BY path_key LIMIT 100"""
)
def khop_with_groups(spark, sf_dir):
    """Stored edges and group relations together; the first length already fills the limit."""
    return _match_paths(spark, sf_dir, with_groups=True)[1].select("depth", "path_key")


@query(
    f"""WITH {PEOPLE}, {SAME}, {GROUP_EDGES}, steps AS (
      SELECT src AS start, src || '|' || type || '|' || dst AS path_key FROM group_edges
      UNION ALL SELECT dst, src || '|' || type || '|' || dst FROM group_edges)
    SELECT start, 1 AS depth, path_key FROM steps ORDER BY start, path_key LIMIT 200"""
)
def member_paths(spark, sf_dir):
    graph = stored_graph(spark, sf_dir)
    return paths.member_paths(graph.nodes, graph.edges, limit=200, sets=graph.sets).select("start", "depth", "path_key")


@query(
    f"""WITH {PEOPLE}, {EDGES}, {BOTH_WAYS}
    two AS (SELECT a.tip AS start, a.edge || ';' || b.edge AS path_key
            FROM ways a JOIN ways b ON b.tip = a.next AND a.edge <> b.edge
            WHERE starts_with(a.tip, 'Member:') AND starts_with(b.next, 'Member:'))
    SELECT start, 2 AS depth, path_key FROM two ORDER BY start, path_key LIMIT 200"""
)
def member_paths_over_parties(spark, sf_dir):
    """Stored edges alone join members only through a party, region or school."""
    graph = stored_graph(spark, sf_dir, with_groups=False)
    return paths.member_paths(graph.nodes, graph.edges, limit=200).select("start", "depth", "path_key")


# --- relations between people --------------------------------------------------------------

# two customers share each name; relatives are named by halved and thirded keys
PERSONS = """
persons AS (
  SELECT c_custkey AS pos, 'P' || (c_custkey // 2) AS name,
    CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS school, n_name AS birthplace,
    'P' || (c_custkey // 3) AS rel1, 'P' || (c_custkey // 2 + 1) AS rel2
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
kin_names AS (SELECT pos, name AS own, rel1 AS rel FROM persons UNION SELECT pos, name, rel2 FROM persons)
"""


def people_table(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")

    def named(number):
        return F.concat(F.lit("P"), F.floor(number).cast("string"))

    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("pos"),
            named(key / 2).alias("name"),
            F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("school"),
            F.col("n_name").alias("birthplace"),
            F.array(named(key / 3), named(key / 2 + 1)).alias("family"),
        )
    )


@query(
    f"""WITH {PERSONS}, keyed AS (SELECT '학연' AS type, school AS key, school || ' 동문' AS "desc" FROM persons WHERE school <> ''
      UNION ALL SELECT '지연', birthplace, birthplace || ' 출신' FROM persons)
    SELECT type, key, "desc", count(*) AS people, count(*) * (count(*) - 1) AS n_relations FROM keyed GROUP BY ALL"""
)
def relation_groups(spark, sf_dir):
    return relations.relation_groups(people_table(spark, sf_dir))


@query(
    f"""WITH {PERSONS}, pairs AS (
      SELECT a.pos, '학연' AS type FROM persons a JOIN persons b ON a.school = b.school AND a.school <> '' AND a.pos <> b.pos
      UNION ALL SELECT a.pos, '지연' FROM persons a JOIN persons b ON a.birthplace = b.birthplace AND a.pos <> b.pos
      UNION ALL SELECT k.pos, '혈연' FROM kin_names k JOIN persons b ON b.name = k.rel AND b.pos <> k.pos)
    SELECT pos, type, count(*) AS n FROM pairs GROUP BY ALL"""
)
def relation_counts(spark, sf_dir):
    return relations.relation_counts(people_table(spark, sf_dir))


@query(
    f"""WITH {PERSONS}, chosen AS (SELECT * FROM persons WHERE contains(name, '{QUERY}')),
    pairs AS (
      SELECT a.name AS source, b.name AS target, '학연' AS type, a.school || ' 동문' AS "desc", a.pos AS source_pos, b.pos AS target_pos
      FROM chosen a JOIN persons b ON a.school = b.school AND a.school <> '' AND a.pos <> b.pos
      UNION ALL SELECT a.name, b.name, '지연', a.birthplace || ' 출신', a.pos, b.pos
      FROM chosen a JOIN persons b ON a.birthplace = b.birthplace AND a.pos <> b.pos
      UNION ALL SELECT k.own, b.name, '혈연', '가족', k.pos, b.pos
      FROM kin_names k JOIN chosen c ON c.pos = k.pos JOIN persons b ON b.name = k.rel AND b.pos <> k.pos)
    SELECT *, 0 AS score FROM pairs"""
)
def relations_of_matches(spark, sf_dir):
    """Relation rows of everyone a name search finds."""
    people = people_table(spark, sf_dir)
    return relations.relations_from(people, search.name_matches(people, QUERY))


@query(
    f"""WITH {PERSONS}, kin AS (
      SELECT DISTINCT name AS src, rel1 AS dst, 'SPOUSE' AS type FROM persons
      UNION SELECT name, rel1, 'FAMILY' FROM persons UNION SELECT name, rel2, 'FAMILY' FROM persons)
    SELECT 'edge' AS kind, src || '|' || type || '|' || dst AS ident, '' AS birth_place FROM kin
    UNION ALL
    SELECT 'node', n.name, coalesce((SELECT arg_max(birthplace, pos) FROM persons p WHERE p.name = n.name), '')
    FROM (SELECT name FROM persons UNION SELECT dst FROM kin) n"""
)
def family_graph(spark, sf_dir):
    people = people_table(spark, sf_dir)
    persons = people.select(
        "name",
        F.lit(None).cast("string").alias("wiki_url"),
        F.col("birthplace").alias("birth_place"),
        F.col("school").alias("party"),
        F.col("family")[0].alias("spouse"),
        F.concat_ws(" , ", "family").alias("family"),
        F.col("pos").alias("ordinal"),
    )
    graph = roster_graph.family_graph(persons)
    edges = graph.edges.select(
        F.lit("edge").alias("kind"),
        F.concat_ws("|", F.substring_index("src", ":", -1), "type", F.substring_index("dst", ":", -1)).alias("ident"),
        F.lit("").alias("birth_place"),
    )
    nodes = graph.nodes.select(
        F.lit("node").alias("kind"),
        F.col("key").alias("ident"),
        fields.or_blank(F.col("props").getItem("birth_place")).alias("birth_place"),
    )
    return edges.unionByName(nodes)


@query(
    r"""SELECT 'MATCH (a:Person {name: ''' || c_name || '''}), (b:Person {name: ''' || n_name ||
      '''}) MERGE (a)-[r:지연 {desc: ''' || n_name || ' \''출신' || ''', score: 0}]->(b);' AS value
       FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def load_statements(spark, sf_dir):
    rel = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_name").alias("source"),
            F.col("n_name").alias("target"),
            F.lit("지연").alias("type"),
            F.concat("n_name", F.lit(" '출신")).alias("desc"),
            F.lit(0).alias("score"),
        )
    )
    return writers.load_statement(rel)


@query(
    """SELECT c_custkey, n_nationkey AS member_id FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE n_regionkey < 3"""
)
def ids_for_names(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    names = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    lookup = nations.where(F.col("n_regionkey") < 3).select(
        F.col("n_name").alias("name"), F.col("n_nationkey").alias("member_id")
    )
    wanted = names.select("c_custkey", F.col("n_name").alias("name"))
    return search.ids_for_names(wanted, lookup).select("c_custkey", "member_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def known_ids_only(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return search.known_only(orders, known, "c_custkey").select("o_orderkey")


@query(
    """SELECT c_name AS name, '' AS balance, c_mktsegment AS segment, c_name || '; ' || c_mktsegment AS both_parts FROM customer
       UNION ALL SELECT s_name, CAST(s_suppkey AS VARCHAR), '', '' FROM supplier"""
)
def union_of_keys(spark, sf_dir):
    """Rows for the text sink: union of columns, lists joined, gaps blank."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.array("c_name", "c_mktsegment").alias("both_parts"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("balance")
    )
    return writers.flat_texts(writers.union_of_keys([customers, suppliers]))
