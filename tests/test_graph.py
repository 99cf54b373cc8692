import random

import pytest
from pyspark.sql import functions as F

from graphjobs.jobs import pipelines
from graphjobs.operators import analytics, cleaning, conflicts, graph
from graphjobs.sources import records
from graphjobs.sources.scratch import written


def test_ties_of_votes_go_to_the_first_seen(spark):
    rows = [("n", x, i) for i, x in enumerate("XYXY")] + [("m", "B", 9), ("m", "A", 10)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "name string, label string, pos long").repartition(parts)
        assert {tuple(r) for r in cleaning.resolve_labels(df).collect()} == {("n", "X"), ("m", "B")}


REL = "source string, target string, type string, season string, row_no long"


def test_bad_relations_have_their_reasons(spark):
    rows = [("足经络", "地", "应", "", 2), ("中医", "天热易出汗", "认为", "", 3), ("处暑", "处暑", "对应节气", "", 4), ("立春", "羊肉", "", "", 5), ("立春", "羊肉", "宜", None, 6), ("立春", "羊肉", "宜", "未知", 7), ("立春", "牛肉", "宜", "冬至", 8)]
    rels = spark.createDataFrame(rows, REL)
    nodes = spark.createDataFrame([("立春",), ("羊肉",)], "name string")
    kept, rejects = cleaning.clean_relations(rels, nodes)
    assert [tuple(r) for r in kept.collect()] == [("立春", "羊肉", "宜", "立春", 6)]
    got = {r.row_no: (r.category, r.reason) for r in rejects.collect()}
    assert got == {
        2: ("reject_relation_bad_entity", "Head:passed, Tail:entity_too_short"), 3: ("reject_relation_bad_entity", "Head:entity_blacklist, Tail:passed"),
        4: ("reject_relation_self_loop", None), 5: ("reject_relation_format_error", None), 8: ("reject_relation_missing_node", None),
    }
    assert cleaning.clean_relations(rels, nodes.limit(0))[0].count() == 2


def test_clean_graph_job(spark):
    mentions = spark.createDataFrame([(1, "ctx", [("“立春", "SolarTerm"), ("羊肉", None), ("我们", "x")]), (2, None, [("羊肉", "FoodHerb"), ("羊肉", "FoodHerb")]), (3, "c", None)], "line_no long, context string, entities array<struct<name:string,label:string>>")
    rels = spark.createDataFrame([("立春", "羊肉", "宜食", "", 2), ("立春", "无", "宜", "", 3)], REL)
    nodes, kept, rejects = pipelines.clean_graph(mentions, rels)
    assert {tuple(r) for r in nodes.collect()} == {("立春", "SolarTerm"), ("羊肉", "FoodHerb")}
    assert kept.count() == 1
    assert {r.category for r in rejects.collect()} == {"reject_node_entity_blacklist", "reject_relation_bad_entity"}
    names = {r.name for r in nodes.collect()}
    assert all(r.source in names and r.target in names for r in kept.collect())
    graph_nodes, edges = pipelines.build_graph(nodes, kept)
    assert graph_nodes.count() == 2 and edges.count() == 1


def test_edges_fan_out_and_the_last_write_wins(spark):
    ents = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), ("a", "X")], "name string, label string")
    nodes = graph.merge_nodes(ents)
    rels = spark.createDataFrame([("a", "b", "r-1", "s1", 2), ("a", "b", "r 1", "s2", 3), ("a", "b", "r-1", "s3", 4), ("a", "zz", "r", "", 5)], REL)
    edges = graph.merge_edges(rels, nodes).collect()
    assert len(edges) == 2 and {(e.rel_type, e.type, e.season) for e in edges} == {("r_1", "r 1", "s2")}


def test_edges_make_their_relations_once(spark, tmp_path):
    """Of a large join, only its written rows are read for turns and edges; the last row of the
    last type wins, by the types' first rows."""
    rows = [("a", "b", "t x", "s1", 1), ("a", "b", "t-x", "s2", 5), ("a", "b", "t x", "s3", 9), ("a", "b", "t-x", "s4", 7), ("a", "b", None, "s5", 20), ("b", "a", "u", None, 2), ("b", "a", "u", "s6", 2), ("a", "nowhere", "u", "s7", 3)]
    spark.createDataFrame(rows, "source string, target string, type string, season string, row_no long").write.parquet(str(tmp_path / "made"))
    nodes = graph.merge_nodes(spark.createDataFrame([("a", "L"), ("a", "M"), ("b", "L")], "name string, label string"))
    edges = graph.merge_edges(spark.read.parquet(str(tmp_path / "made")), nodes)
    assert not [f for f in edges.inputFiles() if "/made/" in f]
    assert sorted((r.rel_type, r.type, r.season) for r in edges.collect()) == [("t_x", "t-x", "s4")] * 2 + [("u", "u", "s6")] * 2
    records.write_graph(nodes, edges, str(tmp_path / "graph"))
    back = spark.read.parquet(str(tmp_path / "graph/edges"))
    assert back.count() == 4 and all(".zstd." in f for f in back.inputFiles())


NODES = "node_id string, name string, labels array<string>"
EDGES = "edge_id string, src_id string, dst_id string, rel_type string, type string, season string"


def small_graph(spark):
    nodes = [("1", "a", ["X"]), ("2", "a", ["Y"]), ("3", "b c", ["X"]), ("4", "bc", ["X"]), ("5", "lone", ["X"]), ("6", "kept", ["Person"])]
    edges = [("e1", "1", "3", "r", "r", "未知"), ("e2", "1", "3", "r", "r", "立春"), ("e3", "2", "4", "r", "r", None), ("e4", "3", "3", "s", "s", ""), ("e5", "1", "3", "r", "r", "冬至")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_fixes(spark):
    nodes, edges = small_graph(spark)
    assert {r.edge_id: r.season for r in conflicts.unify_seasons(edges).collect()}["e1"] == "立春"
    assert {r.name for r in conflicts.normalize_node_names(nodes).collect()} == {"a", "bc", "lone", "kept"}
    assert {r.node_id for r in conflicts.remove_isolated(nodes, edges).collect()} == {"1", "2", "3", "4", "6"}
    assert {r.node_id for r in conflicts.remove_isolated(nodes, edges, (), limit=1).collect()} == {"1", "2", "3", "4", "6"}
    _, dropped = conflicts.merge_duplicate_nodes(nodes, edges)
    assert {r.edge_id for r in dropped.collect()} == {"e1", "e2", "e4", "e5"}
    kept, moved = conflicts.merge_duplicate_nodes(nodes, edges, "rewire")
    assert {r.node_id: r.labels for r in kept.collect()}["1"] == ["X", "Y"]
    assert {(r.src_id, r.dst_id) for r in moved.collect()} == {("1", "3"), ("1", "4"), ("3", "3")}


def test_resolving_twice_changes_nothing_more(spark):
    nodes, edges = small_graph(spark)
    for mode in ("drop", "rewire"):
        n1, e1, _ = conflicts.resolve_conflicts(nodes, edges, dry_run=False, mode=mode)
        n2, e2, report = conflicts.resolve_conflicts(n1, e1, dry_run=False, mode=mode)
        assert sorted(map(repr, n1.collect())) == sorted(map(repr, n2.collect()))
        assert sorted(map(repr, e1.collect())) == sorted(map(repr, e2.collect()))
        assert all(r.planned == 0 for r in report.collect())
    same_nodes, same_edges, report = conflicts.resolve_conflicts(nodes, edges)
    assert same_nodes is nodes and same_edges is edges and {r.step: r.planned for r in report.collect()}["self_loops"] == 1


def brute_paths(edges, src, dst, depth):
    near = {}
    for _, a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, seen = {src}, {src}
    for d in range(1, depth + 1):
        level = {y for x in level for y in near.get(x, ())} - seen
        if dst in level:
            return d
        seen |= level
    return None


def held_against_brute_force(spark, nodes, edges, pairs, depth):
    found = analytics.shortest_path(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "pair_id long, src string, dst string"), depth).collect()
    by_pair = {}
    for r in found:
        by_pair.setdefault(r.pair_id, []).append(r)
    names = {i: n for i, n, _ in nodes}
    ends = {(names[a], names[b]) for _, a, b, *_ in edges} | {(names[b], names[a]) for _, a, b, *_ in edges}
    for pair_id, src, dst in pairs:
        sides = [[i for i, n in names.items() if n == x] for x in (src, dst)]
        lengths = [n for a in sides[0] for b in sides[1] if (n := brute_paths(edges, a, b, depth))]
        hops = sorted(by_pair.get(pair_id, []), key=lambda r: r.hop)
        assert len(hops) == (min(lengths, default=0) if src != dst else 0), (pair_id, src, dst)
        if hops:
            assert [h.hop for h in hops] == list(range(1, len(hops) + 1))
            assert hops[0].source == src and hops[-1].target == dst
            assert all(a.target == b.source for a, b in zip(hops, hops[1:])) and all((h.source, h.target) in ends for h in hops)


def test_shortest_paths_against_brute_force(spark):
    rng = random.Random(7)
    nodes = [(str(i), f"n{i % 38}", ["X"]) for i in range(40)]
    edges = [(f"e{k:03}", str(rng.randrange(36)), str(rng.randrange(36)), "r", None if k % 3 else f"t{k}", "") for k in range(50)]
    pairs = [(k, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for k in range(60)] + [(99, "n1", "n1"), (98, "n1", "nowhere")]
    held_against_brute_force(spark, nodes, edges, pairs, 4)


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_shortest_paths_where_much_hangs_on_little(spark, depth):
    """Trees on a ring, chains, a star, two nodes with only each other, one alone."""
    rng = random.Random(8)
    links = [(k, (k + 1) % 5) for k in range(5)] + [(k, rng.randrange(max(1, k - 6), k)) for k in range(6, 30)]
    links += [(30, 31), (32, 33), (33, 34), (34, 35), (36, 36)] + [(2, 40 + k) for k in range(9)] + [(2, 2), (40, 2)]
    edges = [(f"e{k:03}", str(a), str(b), "r", "t", None) for k, (a, b) in enumerate(links)]
    nodes = [(str(i), f"n{i}", ["X"]) for i in range(50)]
    pairs = [(k, f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for k in range(80)] + [(90, "n30", "n31"), (91, "n32", "n35"), (92, "n40", "n48"), (93, "n41", "n2")]
    held_against_brute_force(spark, nodes, edges, pairs, depth)


def test_path_search_keeps_only_what_lies_around_the_ends(spark, monkeypatch):
    """Two customers of one region, and a large part of the graph that no path reaches."""
    near = [("c1", "n1"), ("c2", "n2"), ("n1", "r"), ("n2", "r"), ("s1", "n1")]
    far = [(f"s{k % 40 + 1}", f"p{k % 700}") for k in range(3000)]
    edges = [(f"e{k:05}", a, b, "r", "t", None) for k, (a, b) in enumerate(near + far)]
    nodes = [(i, f"n_{i}", ["X"]) for i in sorted({x for pair in near + far for x in pair})]
    sizes = {}

    def noted(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(analytics, "written", noted)
    found = analytics.shortest_path(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1, "n_c1", "n_c2")], "pair_id long, src string, dst string")).collect()
    assert [(r.hop, r.source, r.target) for r in sorted(found)] == [(1, "n_c1", "n_n1"), (2, "n_n1", "n_r"), (3, "n_r", "n_n2"), (4, "n_n2", "n_c2")]
    assert max(sizes.values()) <= 2 * len(near)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_surroundings_hold_every_edge_of_a_path(spark, depth):
    rng = random.Random(depth)
    edges = [(f"e{k:03}", str(rng.randrange(60)), str(rng.randrange(60)), "r", "t", "") for k in range(70)] + [("loop", "1", "1", "r", "t", "")]
    ends = {str(rng.randrange(60)) for _ in range(6)}
    kept = [r.edge_id for r in analytics.surroundings(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(e,) for e in ends], "node_id string"), depth).collect()]
    near = set(ends)
    for _ in range((depth - 1) // 2):
        near |= {x for _, a, b, *_ in edges if a != b and {a, b} & near for x in (a, b)}
    assert sorted(kept) == sorted(e for e, a, b, *_ in edges if a != b and {a, b} & near)


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    nodes, edges = small_graph(spark)
    got = [tuple(r) for r in analytics.top_degree(nodes.repartition(parts), edges.repartition(parts), k=3).collect()]
    assert got == [("b c", ["X"], 4), ("a", ["X"], 3), ("a", ["Y"], 1)]
    rows = {r.term: r for r in analytics.term_coverage(nodes.repartition(parts), edges, ("a", "zz")).collect()}
    assert rows["a"].degree == 4 and rows["a"].connected and not rows["zz"].present


def test_neighbors_limit(spark):
    nodes, edges = small_graph(spark)
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    got = analytics.entity_neighbors(nodes, edges, names, limit=2).collect()
    assert len(got) == 2 and {r.direction for r in got} == {"out"}
    assert edges.filter(F.col("season").isNull()).count() == 1


def test_general_query_against_a_plain_loop(spark):
    rng = random.Random(17)
    names = ["立春食", "冬至", "茶", "粥茶", "a", "ab", "", "春立", "立春立春"]
    nodes = [(str(i), f"{rng.choice(names)}{i % 7 or ''}", ["X"]) for i in range(30)]
    edges = [(f"e{k:03}", str(rng.randrange(30)), str(rng.randrange(30)), "rel", rng.choice([None, "宜食", "宜", "ab茶", "食"]), rng.choice([None, "", "立春", "冬至"])) for k in range(300)]
    seasons, words = [None, "立春", "冬至", "", "春", "无"], [[], ["宜"], ["茶", "宜食"], ["ab", "b", "无"], ["无"], ["食", ""]]
    requests = [(k, s, w) for k, (s, w) in enumerate([(s, w) for s in seasons for w in words] * 2)]
    frames = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(requests, "request_id long, season string, keywords array<string>")
    named = {i: n for i, n, _ in nodes}
    want = []
    for request_id, season, keywords in requests:
        found = []
        for _, src, dst, rel, kind, own in edges:
            s, t, own = named[src], named[dst], own or ""
            if season and not (own == season or season in s or season in t):
                continue
            if keywords and not any(w in (kind or "") or w in t for w in keywords):
                continue
            found.append((0 if season and own == season else 1, kind or rel, t, s, own))
        want += [(request_id, s, r, t, own, n) for n, (_, r, t, s, own) in enumerate(sorted(found)[:10], 1)]
    got = analytics.general_query(*frames, limit=10)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "NestedLoop" not in analytics.general_query(*frames)._jdf.queryExecution().executedPlan().toString()
