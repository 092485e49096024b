"""Graph operators: both ways of execution agree, known small graphs, invariants of heuristics."""

import itertools
import random

import numpy as np
import pytest

from quillrake.operators import graph
from quillrake.operators.graph import drift, exchange


def edges(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "source long, target long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def digits(df):
    return sorted((r[0], round(r[1], 9)) for r in df.collect())


@pytest.fixture(scope="module", params=[1, 2])
def messy(spark, request):
    """Loops, repeated edges, sinks, cycles, several components."""
    r = random.Random(request.param)
    return edges(spark, [(r.randrange(14), r.randrange(14)) for _ in range(20)] + [(20, 21), (21, 20), (30, 30), (40, 41), (40, 41)])


CASES = {
    "bfs": lambda e, m: rows(graph.bfs(e, [0, 20, 99], 3, mode=m).select("node", "hop", "seed", "parent")),
    "bfs_undirected": lambda e, m: rows(graph.bfs(e, [1], directed=False, mode=m).select("node", "hop")),
    "bfs_capped": lambda e, m: rows(graph.bfs(e, [0], 4, max_degree=1, max_nodes=3, mode=m).select("node")),
    "components": lambda e, m: rows(graph.connected_components(e, m)),
    "strong": lambda e, m: rows(graph.strongly_connected_components(e, m)),
    "labels": lambda e, m: rows(graph.label_propagation(e, 4, m)),
    "pagerank": lambda e, m: digits(graph.pagerank(e, iterations=5, mode=m)),
    "personal": lambda e, m: digits(graph.personalized_pagerank(e, [0, 5, 99], iterations=4, directed=True, seed_weights=[1, 2, 3], mode=m)),
    "personal_undirected": lambda e, m: digits(graph.personalized_pagerank(e, [21], iterations=4, mode=m)),
    "connecting": lambda e, m: rows(graph.connecting_paths(e, [0, 5, 21], directed=False, mode=m)),
    "subgraph": lambda e, m: rows(graph.subgraph(e, [0, 40], 2, directed=False, mode=m)),
}


@pytest.mark.parametrize("case", CASES)
def test_ways_agree(messy, case):
    assert CASES[case](messy, "in_memory") == CASES[case](messy, "out_of_core")


def test_levels_agree_and_cycles_fail(spark):
    dag = edges(spark, [(a, b) for a, b in itertools.combinations(range(7), 2) if (a * b) % 3 != 1])
    assert rows(graph.topological_levels(dag, mode="in_memory")) == rows(graph.topological_levels(dag, mode="out_of_core"))
    for mode in ("in_memory", "out_of_core"):
        with pytest.raises(Exception, match="cycle"):
            graph.topological_levels(edges(spark, [(1, 2), (2, 1)]), 5, mode).collect()


def test_paths(spark):
    diamond = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    assert rows(graph.all_shortest_paths(diamond, 1, 4)) == [([1, 2, 4],), ([1, 3, 4],)]
    for mode in ("in_memory", "out_of_core"):
        assert rows(graph.shortest_path(diamond, 1, 5, mode=mode)) == [(1, 0), (2, 1), (4, 2), (5, 3)]
        assert rows(graph.shortest_path(diamond, 5, 1, mode=mode)) == []
    assert rows(graph.shortest_path(diamond, 5, 1, directed=False)) == [(1, 3), (2, 2), (4, 1), (5, 0)]
    assert rows(graph.shortest_path(diamond, 3, 3)) == [(3, 0)] and rows(graph.shortest_path(diamond, 9, 9)) == []
    assert rows(graph.all_shortest_paths(diamond, 5, 1)) == []


def test_measures(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (1, 2)])
    assert rows(graph.degrees(e)) == [(1, 2), (2, 1), (3, 1), (4, 0)]
    assert graph.triangle_count(e).first()[0] == 1 == graph.triangle_count(e, directed=False).first()[0]
    assert graph.jaccard(e, 1, 4).first()[0] == pytest.approx(1 / 2) and graph.jaccard(e, 8, 9).first()[0] == 0
    assert graph.preferential_attachment(e, 1, 3).first()[0] == 9
    assert dict(rows(graph.clustering_coefficient(e)))[3] == pytest.approx(1 / 3)
    assert dict(rows(graph.closeness(e)))[1] == pytest.approx(3 / 4) and dict(rows(graph.closeness(e)))[4] == 0
    assert dict(rows(graph.betweenness(e))) == {1: 0, 2: 0, 3: 2, 4: 0}
    assert tuple(graph.average_path_length(e).first()) == (6, pytest.approx(8 / 6))
    assert graph.density(e).first()[0] == pytest.approx(10 / 12)


def test_empty_graph(spark):
    e = edges(spark, [])
    for df in (graph.pagerank(e), graph.connected_components(e), graph.strongly_connected_components(e), graph.label_propagation(e), graph.louvain(e), graph.betweenness(e), graph.degrees(e), graph.shortest_path(e, 1, 2), graph.pagerank(e, mode="out_of_core"), graph.strongly_connected_components(e, "out_of_core"), drift.drift_search(e)):
        assert df.count() == 0
    assert graph.density(e).first()[0] == 0 and graph.triangle_count(e).first()[0] == 0


def test_null_ends_and_odd_names(spark):
    df = spark.createDataFrame([("1", 2, 0.5), (None, 3, 1.0), ("4", None, None)], "src string, dst int, w double")
    assert rows(graph.edge_table(df, weight="w")) == [(1, 2, 0.5)]
    with pytest.raises(ValueError):
        graph.edge_table(df.select("w"))


CLIQUES = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(4, 10)]


def test_communities(spark):
    e = edges(spark, CLIQUES)
    want = [(n, 0 if n < 10 else 10) for n in (*range(5), *range(10, 15))]
    assert rows(graph.louvain(e)) == want == rows(graph.leiden(e)) == rows(graph.label_propagation(e))
    both = graph.groups.with_communities(e, graph.louvain(e))
    alone = graph.groups.with_communities(e, graph.louvain(e).selectExpr("node", "node AS community"))
    assert graph.modularity(both).first()[0] > 0.4 > 0 > graph.modularity(alone).first()[0]


def test_leiden_communities_are_connected(spark):
    r = random.Random(3)
    e = edges(spark, [(r.randrange(40), r.randrange(40)) for _ in range(70)])
    parts = graph.groups.with_communities(e, graph.leiden(e)).where("source_community = target_community")
    comps = {r["node"]: r["component"] for r in graph.connected_components(parts).collect()}
    for node, c in rows(graph.leiden(e)):
        assert comps.get(node, node) == c


def test_drift_finds_the_seeds_surroundings(spark):
    e = graph.edges.both_ways(edges(spark, CLIQUES))
    found = {r[0] for r in drift.regional_drift(e, [0], 1).collect()}
    assert found and found <= set(range(5))
    assert {r[0] for r in drift.drift_search(e, [12]).collect()} & set(range(10, 15))
    assert {r["community"]: r["size"] for r in drift.community_summaries(edges(spark, CLIQUES), [1]).collect()} == {0: 5, 10: 5}
    said = drift.community_summaries(edges(spark, CLIQUES), summarize=lambda c, m: f"{c}:{len(m)}").collect()
    assert {r["summary"] for r in said} == {"0:5", "10:5"}
    assert drift.graph_rag_global(edges(spark, CLIQUES), [11], 1).first()["community"] == 10


def test_exports(spark, tmp_path):
    e = edges(spark, [(1, 2), (2, 3)])
    assert exchange.to_graphviz(e) == "digraph G {\n  1 -> 2;\n  2 -> 3;\n}"
    assert exchange.to_edge_list(e) == "1 2\n2 3"
    assert exchange.to_graphml(e).count("<edge ") == 2 and exchange.to_gml(e).count("node [") == 3 and '"@id": "urn:node:3"' in exchange.to_json_ld(e)
    (tmp_path / "e.txt").write_text("# a comment\n1 2\n2 3\n")
    assert rows(exchange.from_edge_list(spark, str(tmp_path / "e.txt"))) == [(1, 2), (2, 3)]


def test_too_large_for_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 1)
    e = edges(spark, [(1, 2), (2, 3)])
    with pytest.raises(ValueError):
        graph.pagerank(e, mode="in_memory")
    with pytest.raises(ValueError):
        graph.louvain(e)
    assert rows(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 1)]


def test_components_of_any_size_contract(spark, messy, monkeypatch):
    """With nothing that fits one task, chunks are contracted level by level."""
    want = rows(graph.connected_components(messy, "in_memory"))
    way = edges(spark, [(i, i + 1) for i in range(100, 112)] + [(i, 300 - i) for i in range(190, 200)]).repartition(3)
    expected = rows(graph.connected_components(way, "in_memory"))
    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graph.edges, "CHUNK", 2)
    assert rows(graph.connected_components(messy.repartition(5))) == want
    assert rows(graph.connected_components(way)) == expected


def test_components_are_dealt_to_tasks(spark, monkeypatch):
    """A graph beyond one task, of components that fit: results are those of one task over the whole graph."""
    r = random.Random(5)
    many = edges(spark, [(20 * c + r.randrange(12), 20 * c + r.randrange(12)) for c in range(5) for _ in range(24)])
    weighted = many.withColumn("weight", (many["source"] * 7 + many["target"]) % 3 + 1.0)
    dag = many.where("source < target")
    of = lambda: (rows(graph.louvain(many)), rows(graph.leiden(many, resolution=2.0)), rows(graph.louvain(weighted, "weight")), rows(graph.strongly_connected_components(many)), rows(graph.topological_levels(dag)))
    want = of()
    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 30)
    monkeypatch.setattr(graph.edges, "CHUNK", 40)
    assert of() == want
    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 5)  # components too large: the way by frames
    assert rows(graph.topological_levels(dag)) == want[4]
    with pytest.raises(ValueError, match="hang together"):
        graph.louvain(many)


def test_path_centralities_of_any_size_agree_with_plain_walks(spark, messy, monkeypatch):
    """In batches that are halved, and as tables of pairs, against one walk after the other."""
    links = {tuple(r) for r in messy.collect() if r[0] != r[1]}
    nodes = sorted({n for r in messy.collect() for n in r})
    out = {n: sorted(b for a, b in links if a == n) for n in nodes}
    hop, ways = {}, {}
    for s in nodes:
        hop[s], ways[s], now = {s: 0}, {s: 1}, [s]
        while now:
            then = []
            for u in now:
                for v in out[u]:
                    if v not in hop[s]:
                        hop[s][v], ways[s][v] = hop[s][u] + 1, 0
                        then.append(v)
                    if hop[s][v] == hop[s][u] + 1:
                        ways[s][v] += ways[s][u]
            now = then
    close = [(s, round((len(hop[s]) - 1) / t, 9) if (t := sum(hop[s].values())) else 0.0) for s in nodes]
    through = lambda v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in nodes for t in hop[s] if v not in (s, t) and v in hop[s] and t in hop[v] and hop[s][v] + hop[v][t] == hop[s][t])
    between = [(v, round(through(v), 9)) for v in nodes]
    far = [h for s in nodes for h in hop[s].values() if h]
    from_two = [h for s in (0, 20) for h in hop.get(s, {}).values() if h]
    two = spark.createDataFrame([(0,), (20,), (77,)], "node long")

    def check():
        assert digits(graph.closeness(messy)) == close and digits(graph.betweenness(messy)) == between
        assert tuple(graph.average_path_length(messy).first()) == (len(far), pytest.approx(sum(far) / len(far)))
        assert tuple(graph.average_path_length(messy, two).first()) == (len(from_two), pytest.approx(sum(from_two) / len(from_two)))

    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 3)
    check()
    monkeypatch.undo()
    walks = graph.measures._Walks(graph.edges.gathered(iter(messy.toArrow().to_batches())))
    monkeypatch.setattr(graph.measures, "_STEPS", 5)
    assert sum(len(p) for _, layers in walks.batches(np.arange(len(nodes))) for p, _, _ in layers[1:]) == len(far)
    check()


def test_clustering_does_not_pair_the_neighbours_of_a_hub(spark):
    hub = edges(spark, [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1, 199)])
    ranked = graph.measures._ranked(hub)
    assert ranked.count() == 397 and max(r[1] for r in ranked.groupBy("source").count().collect()) <= 3
    got = dict(rows(graph.clustering_coefficient(hub)))
    assert got[0] == pytest.approx(2 * 198 / (199 * 198)) and got[1] == 1 and got[100] == pytest.approx(2 / 3)


def test_drift_on_dealt_components_is_that_of_one_task(spark, monkeypatch):
    r = random.Random(8)
    many = graph.edges.both_ways(edges(spark, [(40 * c + r.randrange(25), 40 * c + r.randrange(25)) for c in range(6) for _ in range(60)]))
    want = rows(drift.drift_search(many)), rows(drift.drift_search(many, [41, 85])), rows(drift.regional_drift(many, [3, 44], 2))
    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 130)
    assert (rows(drift.drift_search(many)), rows(drift.drift_search(many, [41, 85])), rows(drift.regional_drift(many, [3, 44], 2))) == want
    monkeypatch.setattr(graph.edges, "LOCAL_EDGES", 20)
    with pytest.raises(ValueError, match="drifting"):
        drift.drift_search(many)
