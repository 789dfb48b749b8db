"""Roster graph, group relations, relations and paths, against brute force and hand-derived results."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from relgraph.operators import groups, paths, relations, search, tables
from relgraph.plans import roster_graph
from relgraph.sources import readers

LINK = "https://host/members/22nd/"
ROSTER = [
    {"name": "가", "party": "P1", "detail_link": LINK + "a", "선거구": "서울 강남구갑",
     "당선횟수": "2선(제17대, 제18대)", "약력": ["서울대학교 졸업", "부산대학교 졸업", "변호사"]},
    {"name": "나", "party": "P1", "detail_link": LINK + "b", "선거구": "서울 강남구갑",
     "당선횟수": "재선(제18대, 제22대)", "약력": ["서울대학교 졸업", "부산대학교 졸업"]},
    {"name": "다", "party": "P2", "detail_link": LINK + "c", "선거구": "서울 종로구",
     "당선횟수": "초선(제22대)", "약력": ["부산대학교 법학과"]},
    {"name": "라", "party": "P2", "detail_link": LINK + "d", "선거구": "비례대표"},
    {"name": "마", "party": "P1", "detail_link": LINK + "e", "선거구": "비례대표", "당선횟수": ""},
    {"name": "바", "party": "P3", "detail_link": LINK, "선거구": "부산 남구"},
    {"name": "라", "party": "P1", "detail_link": LINK + "d", "선거구": "비례대표", "email": "d@x"},
]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("roster") / "members.json"
    path.write_text(json.dumps(ROSTER, ensure_ascii=False), encoding="utf-8")
    built = roster_graph.roster_graph(readers.roster_arrays(spark, str(path)))
    return roster_graph.Graph(built.nodes.cache(), built.edges.cache(), built.sets.cache())


def all_edges(graph, etype):
    sets = graph.sets.where(F.col("etype") == etype)
    rows = groups.edges_from(sets, sets.select("id")).collect()
    return {(r.src[-1], r.dst[-1]) for r in rows}


def both(*pairs):
    return {p for a, b in pairs for p in ((a, b), (b, a))}


def test_nodes(graph):
    rows = {r.node_id: r for r in graph.nodes.collect()}
    assert {i for i in rows if i.startswith("Member")} == {f"Member:{c}" for c in "abcde"}
    # an invalid record still brings its party and region
    assert {"Party:P3", "Region:region:남구", "Region:sido:부산"} <= set(rows)
    assert rows["Region:sido:서울"].labels == ["Region", "Sido"]
    # the later record of d replaced the earlier one
    assert rows["Member:d"].props["party"] == "P1" and rows["Member:d"].props["email"] == "d@x"
    assert "sido" not in rows["Member:d"].props


def test_base_edges(graph):
    rows = {(r.src, r.type, r.dst) for r in graph.edges.collect()}
    assert ("Member:d", "BELONGS_TO", "Party:P1") in rows
    assert ("Member:d", "BELONGS_TO", "Party:P2") in rows  # from its first record
    assert ("Region:sido:서울", "CONTAINS", "Region:region:종로구") in rows
    assert ("Member:a", "GRADUATED_FROM", "School:부산대학교") in rows
    assert len(rows) == 6 + 5 + 3 + 5


def test_group_relations(graph):
    assert all_edges(graph, "SAME_PARTY") == both("ab", "ad", "ae", "bd", "be", "de", "cd")
    assert all_edges(graph, "SAME_REGION") == both("ab")
    assert all_edges(graph, "SAME_TERM") == both("ab", "bc")
    assert all_edges(graph, "SAME_SCHOOL") == both("ab", "ac", "bc")


def test_same_sido(spark):
    m = spark.createDataFrame(
        [("a", "서울"), ("b", "서울"), ("c", "서울"), ("d", None), ("e", None)], "id string, sido string"
    )
    sets = groups.region_key_sets(None, None, m, "same_sido")
    got = {(r.src, r.dst) for r in groups.edges_from(sets, m).collect()}
    assert got == both("ab", "ac", "bc")


def test_district_meets_its_sido(spark):
    # "서울 서울" represents the sido node above 강남
    rep = spark.createDataFrame([("a", "강남"), ("b", "서울"), ("c", "종로")], "id string, region string")
    con = spark.createDataFrame([("서울", "강남"), ("서울", "서울"), ("서울", "종로")], "sido string, region string")
    m = spark.createDataFrame([(c, "서울") for c in "abc"], "id string, sido string")
    sets = groups.region_key_sets(rep, con, m)
    assert {(r.src, r.dst) for r in groups.edges_from(sets, m).collect()} == both("ab", "bc")
    assert {r.id: r.n for r in groups.related_counts(sets).collect()} == {"a": 1, "b": 2, "c": 1}


@pytest.mark.parametrize("widest", [12, 0])
def test_related_counts_equal_brute_force(spark, monkeypatch, widest):
    monkeypatch.setattr(groups, "MAX_SUBSET_KEYS", widest)
    rng = random.Random(7)
    held = {i: {rng.randrange(6) for _ in range(rng.randrange(1, 5))} | ({9} if i % 3 else set()) for i in range(60)}
    pairs = spark.createDataFrame([(str(i), str(k)) for i, ks in held.items() for k in ks], "id string, key string")
    sets = groups.key_sets(pairs, "T", "id", "key")
    got = {int(r.id): r.n for r in groups.related_counts(sets).collect()}
    assert got == {i: sum(1 for j in held if j != i and held[i] & held[j]) for i in held}
    edges = groups.edges_from(sets, sets)
    assert edges.count() == sum(got.values())


def test_statistics(graph):
    stats = tables.statistics(graph.nodes, graph.edges, groups.related_counts(graph.sets))
    got = {(r.kind, r.name): r.n for r in stats.collect()}
    assert got == {
        ("node", "Member"): 5, ("node", "Party"): 3, ("node", "Region"): 6, ("node", "School"): 2,
        ("edge", "BELONGS_TO"): 6, ("edge", "REPRESENTS"): 5, ("edge", "GRADUATED_FROM"): 5,
        ("edge", "SAME_PARTY"): 14, ("edge", "SAME_REGION"): 2, ("edge", "SAME_TERM"): 4,
        ("edge", "SAME_SCHOOL"): 6,
    }


def test_roster_only_members(spark):
    rows = [(1, None, "x", "P"), (2, "", "y", "Q"), (3, "7", "z", "R")]
    df = spark.createDataFrame(rows, "ordinal long, monaCd string, name string, party string")
    from relgraph.schemas import ROSTER as shape

    for f in shape.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    got = {r.mona_code: r.name for r in roster_graph.code_only_members(readers.normal_roster(df)).collect()}
    assert got == {"": "y", "7": "z"}


PEOPLE = [
    (0, "이재명", "서울대", "경기도", ["이해찬"]),
    (1, "김기현", "서울대", "울산", ["김철수"]),
    (2, "이준석", "하버드", "서울", []),
    (3, "이해찬", "서울대", "경기도", ["이재명"]),
]


def people_df(spark, rows=PEOPLE):
    return spark.createDataFrame(
        rows, "pos long, name string, school string, birthplace string, family array<string>"
    )


def test_pair_relations(spark):
    people = people_df(spark)
    rows = relations.relations_from(people, people).collect()
    kinds = [r.type for r in rows]
    assert (kinds.count("학연"), kinds.count("지연"), kinds.count("혈연")) == (6, 2, 2)
    assert {(r.source, r.target, r.desc) for r in rows if r.type == "지연"} == {
        ("이재명", "이해찬", "경기도 출신"), ("이해찬", "이재명", "경기도 출신"),
    }
    counts = {(r.pos, r.type): r.n for r in relations.relation_counts(people).collect()}
    assert counts == {
        (0, "학연"): 2, (1, "학연"): 2, (3, "학연"): 2, (0, "지연"): 1, (3, "지연"): 1,
        (0, "혈연"): 1, (3, "혈연"): 1,
    }
    folded = {(r.type, r.key): r.n_relations for r in relations.relation_groups(people).collect()}
    assert folded["학연", "서울대"] == 6 and folded["지연", "경기도"] == 2


def test_relation_counts_with_namesakes(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice("xyz"), rng.choice(["s", "t", "", None]), rng.choice(["b", "c"]),
         [rng.choice("xyzw") for _ in range(rng.randrange(3))])
        for i in range(40)
    ]
    people = people_df(spark, rows)
    listed = {}
    for r in relations.relations_from(people, people).collect():
        listed[r.source_pos, r.type] = listed.get((r.source_pos, r.type), 0) + 1
    brute = {}
    for p, q in itertools.permutations(rows, 2):
        for kind, hit in (
            ("학연", p[2] and p[2] == q[2]), ("지연", p[3] and p[3] == q[3]), ("혈연", q[1] in p[4]),
        ):
            if hit:
                brute[p[0], kind] = brute.get((p[0], kind), 0) + 1
    assert listed == brute
    assert {(r.pos, r.type): r.n for r in relations.relation_counts(people).collect()} == brute


def test_family_graph(spark):
    rows = [
        ("A", "w", "서울", "P", "B", "C, D,,C", 1),
        ("B", "u", None, None, None, "", 2),
        ("E", None, None, None, " ", None, 3),
    ]
    persons = spark.createDataFrame(
        rows,
        "name string, wiki_url string, birth_place string, party string, spouse string, family string, ordinal long",
    )
    graph = roster_graph.family_graph(persons)
    edges = {(r.src[7:], r.type, r.dst[7:]) for r in graph.edges.collect()}
    assert edges == {("A", "SPOUSE", "B"), ("A", "FAMILY", "C"), ("A", "FAMILY", "D")}
    props = {r.key: r.props for r in graph.nodes.collect()}
    assert set(props) == set("ABCDE")
    assert props["B"]["wiki_url"] == "u" and props["C"] == {"name": "C"}


# --- paths ------------------------------------------------------------------------------


def tiny(spark):
    nodes = spark.createDataFrame(
        [("M1", ["Member"]), ("M2", ["Member"]), ("P", ["Party"])], "node_id string, labels array<string>"
    ).withColumn("key", F.col("node_id")).withColumn("props", F.create_map(F.lit("k"), F.col("node_id")))
    edges = spark.createDataFrame(
        [("M1", "P", "BELONGS_TO"), ("M2", "P", "BELONGS_TO"), ("M1", "M2", "SAME_PARTY"),
         ("M2", "M1", "SAME_PARTY")], "src string, dst string, type string",
    ).withColumn("props", F.create_map(F.lit("a"), F.lit("b")))
    return nodes, edges


def start(spark, name):
    return spark.createDataFrame([(name,)], "node_id string")


def test_trails(spark):
    nodes, edges = tiny(spark)
    one = paths.neighbourhood(nodes, edges, start(spark, "M1"), 1)
    assert one.count() == 3
    two = paths.neighbourhood(nodes, edges, start(spark, "M1"), 2)
    assert two.count() == 8
    assert paths.subgraph_nodes(two, nodes).count() == 3
    assert paths.subgraph_edges(two, edges).count() == 13
    assert paths.subgraph_edges(two, edges, dedupe=True).count() == 4
    out = json.loads(
        paths.subgraph_json(paths.subgraph_nodes(two, nodes), paths.subgraph_edges(two, edges)).first()[0]
    )
    assert len(out["nodes"]) == 3 and len(out["relationships"]) == 13
    with pytest.raises(ValueError):
        paths.neighbourhood(nodes, edges, start(spark, "M1"), 6)


def test_group_relations_walk_like_stored_edges(spark):
    nodes, edges = tiny(spark)
    stored = edges.where(F.col("type") == "BELONGS_TO")
    sets = groups.key_sets(stored, "SAME_PARTY", "src", "dst")
    want = [r.path_key for r in paths.neighbourhood(nodes, edges, start(spark, "M1"), 3).orderBy("depth", "path_key").collect()]
    got = paths.neighbourhood(nodes, stored, start(spark, "M1"), 3, sets=sets).orderBy("depth", "path_key").collect()
    assert [r.path_key for r in got] == want
    pair_want = paths.member_paths(nodes, edges).collect()
    pair_got = paths.member_paths(nodes, stored, sets=sets).collect()
    assert sorted(r.path_key for r in pair_got) == sorted(r.path_key for r in pair_want)
    assert len(pair_got) == 4 + 4 + 2  # one group edge; there and back; over the party


def brute_trails(edges, starts, depth):
    level = [((s,), ()) for s in starts]
    found = []
    for _ in range(depth):
        grown = []
        for nodes, used in level:
            for e in edges:
                if e in used or nodes[-1] not in (e[0], e[2]):
                    continue
                other = e[2] if nodes[-1] == e[0] else e[0]
                grown.append((nodes + (other,), used + (e,)))
        level = grown
        found += level
    return found


def test_paths_equal_brute_force(spark):
    rng = random.Random(5)
    names = [f"M{i}" for i in range(5)] + ["P0", "P1", "X0"]
    label = {"M": "Member", "P": "Party", "X": "Article"}
    edges = sorted({(rng.choice(names), rng.choice("rs"), rng.choice(names)) for _ in range(14)})
    edges = [e for e in edges if e[0] != e[2]]
    nodes_df = spark.createDataFrame([(n, [label[n[0]]]) for n in names], "node_id string, labels array<string>")
    edges_df = spark.createDataFrame(edges, "src string, type string, dst string")

    def text(used):
        return ";".join("|".join(e) for e in used)

    trails = brute_trails(edges, ["M0"], 3)
    want = sorted((len(u), text(u)) for n, u in trails if n[-1][0] != "X")
    for limit in (3, 1000):
        got = paths.neighbourhood(nodes_df, edges_df, start(spark, "M0"), 3, limit).collect()
        assert sorted((r.depth, r.path_key) for r in got) == want[:limit]
    members = [n for n in names if n[0] == "M"]
    pairs = sorted((len(u), n[0], text(u)) for n, u in brute_trails(edges, members, 2) if n[-1][0] == "M")
    for limit in (4, 9, 1000):
        got = paths.member_paths(nodes_df, edges_df, limit).collect()
        assert sorted((r.depth, r.start, r.path_key) for r in got) == pairs[:limit]


def test_search(spark):
    members = spark.createDataFrame(
        [("1", "김기현", 5), ("2", "김민석", 3), ("3", "이재명", 2), (None, "김무", 0)],
        "id string, name string, election_count int",
    )
    belongs = spark.createDataFrame([("1", "P"), ("1", "Q")], "id string, party string")
    represents = spark.createDataFrame([("2", "R")], "id string, region string")
    rows = [tuple(r)[:4] for r in search.member_search(members, belongs, represents, "김").collect()]
    assert [r[0] for r in rows] == ["김기현", "김기현", "김무", "김민석"]
    assert set(rows) == {
        ("김기현", "1", "P", None), ("김기현", "1", "Q", None), ("김무", None, None, None), ("김민석", "2", None, "R"),
    }
    assert [r.id for r in search.first_match(members, "김").collect()] == ["1"]
    assert search.first_match(members, "박").count() == 0
    assert search.name_matches(members, "").count() == 4


def test_upsert_and_violations(spark):
    old = spark.createDataFrame([("k", "old", "x"), ("m", "old", "y")], "key string, v string, w string")
    new = spark.createDataFrame([("k", "n1", None, 1), ("k", "n2", None, 2)], "key string, v string, w string, ordinal long")
    rows = {r.key: (r.v, r.w) for r in tables.upsert(old, new, ["key"], "ordinal").collect()}
    assert rows == {"k": ("n2", None), "m": ("old", "y")}
    assert [(r.key, r.n) for r in tables.key_violations(new, ["key"]).collect()] == [("k", 2)]


def test_relations_of_many_chosen_people_equal_plain_loops(spark, monkeypatch):
    rows = [(i, f"P{i // 2}", f"S{i % 3}" if i % 5 else "", f"B{i % 4}", [f"P{i // 3}", f"P{i // 2 + 1}", f"P{i // 3}"]) for i in range(60)]
    people = spark.createDataFrame(rows, "pos long, name string, school string, birthplace string, family array<string>")
    chosen = people.where("pos % 2 = 0")
    want = sorted(
        (a[0], b[0], kind, a[1], b[1], text)
        for a in rows if a[0] % 2 == 0 for b in rows if a[0] != b[0]
        for kind, text in [
            *([("학연", a[2] + " 동문")] if a[2] == b[2] != "" else []), *([("지연", a[3] + " 출신")] if a[3] == b[3] else []),
            *([("혈연", "가족")] if b[1] in a[4] else []),
        ]
    )
    monkeypatch.setattr(relations, "BLOCK", 4)
    for most in (0, 100):
        monkeypatch.setattr(relations, "BROADCAST_STARTS", most)
        found = relations.relations_from(people, chosen)
        assert sorted((r.source_pos, r.target_pos, r.type, r.source, r.target, r.desc) for r in found.collect()) == want


def test_relations_of_many_chosen_people_are_not_broadcast(spark, monkeypatch):
    names = F.concat(F.lit("p"), (F.col("id") % 40).cast("string"))
    people = spark.range(60).select(
        F.col("id").alias("pos"),
        names.alias("name"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("school"),
        F.lit("here").alias("birthplace"),
        F.array(F.concat(F.lit("p"), (F.col("id") % 5).cast("string"))).alias("family"),
    )
    chosen = people.where("pos % 2 = 0")
    few = relations.relations_from(people, chosen).collect()
    monkeypatch.setattr(relations, "BROADCAST_STARTS", 0)
    many = relations.relations_from(people, chosen)
    # what is repeated for the salted joins is as small to the planner as it was before
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert sorted(many.collect()) == sorted(few) and len(few) > 30 * 59
