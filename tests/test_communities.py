"""Communities as arrays against the distributed rounds, and what they cost."""

import random

from quillgraph.operators import community as CM
from quillgraph.operators import graph as G

rng = random.Random(5)


def planted(start, blocks, size, name=int):
    n = blocks * size
    return [(name(start + a), name(start + b), float(rng.randint(1, 4))) for a in range(n) for b in range(a + 1, n) if b == a + 1 or rng.random() < (0.6 if a // size == b // size else 0.03)]


def adjacent(spark, edges):
    return G.adjacency(spark.createDataFrame(edges, ["src", "dst", "weight"])).persist()


def levels(parts):
    return [sorted((r.node, r.label) for r in p.collect()) for p in parts]


def test_arrays_follow_the_distributed_rules(spark, monkeypatch):
    edges = planted(0, 8, 7)
    adj = adjacent(spark, edges)
    arrays = levels(CM.hierarchy(adj, rounds=4, levels=2))
    monkeypatch.setattr(CM, "LOCAL", len(edges) - 1)  # the first level by joins, the second one as arrays
    assert levels(CM.hierarchy(adj, rounds=4, levels=2)) == arrays


def test_connected_parts_do_not_touch_each_other(spark, monkeypatch):
    edges = planted(0, 6, 8) + planted(100, 4, 8) + [(500, 501, 1.0)]
    adj = adjacent(spark, edges)
    whole = levels(CM.hierarchy(adj))
    monkeypatch.setattr(CM, "LOCAL", len(edges) - 10)  # two tasks of their own, a shared one
    assert sum(e[0] < 100 for e in edges) <= len(edges) - 10
    assert levels(CM.hierarchy(adj)) == whole
    assert [len(x) for x in whole] == [82] * len(whole) and whole[-1][-2:] == [(500, 500), (501, 500)]


def test_few_jobs_a_hierarchy(spark):
    adj = adjacent(spark, planted(0, 6, 8, "n{}".format))
    adj.count()
    sc = spark.sparkContext
    sc.setJobGroup("hierarchy", "")
    try:
        parts = levels(CM.hierarchy(adj))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len({l for _, l in parts[-1]}) <= 8 and len(sc.statusTracker().getJobIdsForGroup("hierarchy")) < 30
