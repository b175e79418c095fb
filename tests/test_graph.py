import pytest

from quillgraph.operators import align as A
from quillgraph.operators import community as CM
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import ppr as P
from quillgraph.operators import retrieval as R
from quillgraph.operators.components import connected_components


def edges(spark, rows):
    return spark.createDataFrame([(*r, 1.0)[:3] if len(r) == 2 else r for r in rows], "src string, dst string, weight double")


FIVE = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("d", "e")]


def test_adjacency(spark):
    e = edges(spark, FIVE)
    assert G.node_index(e).count() == 5
    both = {(r.src, r.dst): r.weight for r in G.adjacency(e).collect()}
    assert len(both) == 12 and all((b, a) in both for a, b in both)
    assert G.adjacency(e, undirected=False).count() == 6
    near = {}
    for r in G.neighbours(e).collect():
        near.setdefault(r.node, set()).add(r.neighbour)
    assert near == {"a": {"b", "c"}, "b": {"a", "c", "d"}, "c": {"a", "b", "d"}, "d": {"b", "c", "e"}, "e": {"d"}}
    assert [r.idx for r in G.node_index(e).orderBy("node").collect()] == [0, 1, 2, 3, 4]


def scores(spark, rows, seed="A", **kw):
    s = P.uniform_seed(spark.createDataFrame([(seed,)], "node string"))
    return {r.node: r.score for r in P.personalized_pagerank(G.adjacency(edges(spark, rows)), s, **kw).collect()}


def test_pagerank_invariants(spark):
    r = scores(spark, [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0)], alpha=0.15, iterations=40, tolerance=None)
    assert r["B"] == pytest.approx(r["C"], abs=1e-9) and sum(r.values()) == pytest.approx(1)
    h = scores(spark, [("A", "B", 1.0), ("A", "C", 10.0), ("B", "C", 1.0)], iterations=15, tolerance=None)
    assert h["C"] > h["B"]
    big = scores(spark, [("A", "B", 7.0), ("A", "C", 70.0), ("B", "C", 7.0)], iterations=15, tolerance=None)
    assert all(big[k] == pytest.approx(h[k], abs=1e-9) for k in h)


def test_pagerank_stops_early(spark):
    r = scores(spark, [("A", "B", 1.0)], alpha=0.9, iterations=100, tolerance=1e-3)
    assert sum(r.values()) == pytest.approx(1, abs=1e-3) and r["A"] > r["B"]


def test_trails_repeat_no_edge(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1)], "edge_id long, src long, dst long")
    p = G.trail_paths(e, spark.createDataFrame([(1,)], "node long"), 3).collect()
    assert all(len(set(r.edges)) == len(r.edges) == r.hops for r in p)
    assert sorted(map(tuple, (r.nodes for r in p if r.hops == 3))) == [(1, 2, 3, 1), (1, 3, 2, 1)]


def test_components_and_empty(spark):
    c = {r.node: r.component for r in connected_components(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1)], "src long, dst long")).collect()}
    assert c == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 7: 7}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_two_triangles(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3))], "src long, dst long, weight double")
    adj = G.adjacency(e)
    h = CM.hierarchy(adj, rounds=8, levels=2)
    groups = {}
    for r in h[-1].collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5]]
    assert M.modularity(adj, h[-1]).first()[0] == pytest.approx(6 / 7 - 0.5)


def test_parents_vote(spark):
    l = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1)], "level int, node long, label long")
    assert {(r.child, r.parent) for r in CM.parents(l).collect()} == {(0, 0), (1, 1)}


def test_rrf_and_scope(spark):
    a, b = (spark.createDataFrame([(x, i) for i, x in enumerate(l)], "id string, rank int") for l in ("xy", "yz"))
    got = R.rrf([a, b], 3).collect()
    assert [r.id for r in got] == ["y", "x", "z"] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    e = edges(spark, FIVE)
    assert G.scoped(e, None, "src").count() == 6 and G.scoped(e, "a", "src").count() == 2 and G.scoped(e, ["a", "b"], "src", "dst").count() == 1


def test_clearance(spark):
    df = spark.createDataFrame([("public",), ("INTERNAL ",), (None,), ("restricted",)], "accessLevel string")
    assert [R.visible(df, c).count() for c in ("public", "internal", "confidential", "restricted", "none")] == [1, 3, 3, 4, 0]


def test_merge(spark):
    e = spark.createDataFrame([(1, "x", "t", [1.0, 0.0], 5), (2, "x", "t", [0.0, 1.0], 1), (3, "y", "t", [1.0, 0.01], 0), (4, "x", "u", [1.0, 0.0], 9)], "id long, name string, type string, vector array<double>, mentions int")
    m = A.canonical_map(A.clusters(A.duplicate_links(e, 0.92)), e)
    assert {(r.id, r.canonical) for r in m.collect()} == {(1, 1), (2, 1), (3, 1)}
    out = A.merged(e, spark.createDataFrame([("c", 2), ("c", 1)], "chunk string, entity long"), spark.createDataFrame([(2, "k", 4, 1.0), (1, "k", 4, 2.0), (1, "k", 3, 1.0)], "src long, type string, dst long, weight double"), m)
    assert {r.id for r in out["entities"].collect()} == {1, 4}
    assert [(r.src, r.dst, r.weight) for r in out["edges"].collect()] == [(1, 4, 3.0)] and out["mentions"].count() == 1


def test_graph_search(spark):
    vec = lambda rows: spark.createDataFrame(rows, "id string, vector array<double>")
    edges = spark.createDataFrame([(1, "a", "b", "KNOWS", ["c1"]), (2, "b", "d", "KNOWS", ["c2", None]), (3, "a", "d", "FAR", ["c3"])], "edge_id long, src string, dst string, type string, chunkIds array<string>")
    ents = vec([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("d", [0.0, 1.0])])
    rels = vec([("KNOWS", [1.0, 0.0]), ("FAR", [-1.0, 0.0])])
    mentions = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("d", "c3")], "entity string, chunk string")
    q = vec([("q", [1.0, 0.0])])
    allowed = spark.createDataFrame([("c1",), ("c3",)], "chunk string")
    got = R.graph_search(edges, rels, ents, mentions, allowed, q, seeds=1, depth=2).collect()
    assert [r.chunk for r in got] == ["c1"] and got[0].score == pytest.approx(0.6 * (1 + 0.9 / (0.82**0.5)) / 2 + 0.4)
    assert R.retrieve("graph", 5, "nobody", {"graph": lambda k, c: allowed}, allowed).count() == 0 and R.retrieve("graph", 5, "internal", {"graph": lambda k, c: allowed}, allowed).count() == 2
