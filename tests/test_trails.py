"""Counted trails against listed ones."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import trails as T
from quillgraph.plans import graph_queries as GQ


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_counts_of_trails(spark, hops):
    rng = random.Random(8)
    pairs = [(rng.randint(1, 7), rng.randint(1, 7)) for _ in range(16)] + [(1, 1), (1, 1), (2, 3), (3, 2), (8, 9), (None, 1), (1, None)]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")
    seeds = spark.createDataFrame([(1,), (2,), (2,), (9,), (77,), (None,)], "node long")
    listed = G.trail_paths(edges.where("src is not null and dst is not null"), seeds, hops).groupBy("seed", "target", "hops").agg(F.count(F.lit(1)).alias("paths"))
    counted = G.trail_counts(edges, seeds, hops)
    assert counted.columns == listed.columns and Counter(map(tuple, counted.collect())) == Counter(map(tuple, listed.collect()))


def test_no_trail_is_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "trail_paths", None)
    spark.createDataFrame([(1, 100), (1, 2), (2, 2), (2, 3)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(100,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, GQ.trail_paths_depth3(spark, str(tmp_path)).collect())) == [(100, 2, 1, 1), (100, 3, 2, 1)]


def listed_counts(edges, seeds, hops=3):
    return Counter(map(tuple, G.trail_paths(edges, seeds, hops).groupBy("seed", "target", "hops").agg(F.count(F.lit(1)).alias("paths")).collect()))


def shuffled(spark):
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_walk_is_shuffled(spark, tmp_path):
    rng = random.Random(3)
    mentions = [(c, p) for c in range(900) for p in rng.sample(range(600), 5)]
    spark.createDataFrame(mentions, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(100 * p,) for p in range(1, 600)] + [(p * 100_000,) for p in range(9)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    before = shuffled(spark)
    found = GQ.trail_paths_depth3(spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert len(found) > 5_000 and shuffled(spark) - before < 4 * len(mentions)


@pytest.mark.parametrize("held", [0, 40])
def test_groups_too_large_are_divided_and_single_seeds_counted_by_rows(spark, monkeypatch, held):
    rng = random.Random(5)
    pairs = [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(25)] + [(x, x + 1) for x in range(20, 60)] + [(30, 30)]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, src int, dst int")
    seeds = spark.createDataFrame([(x,) for x in [1, 4, *range(20, 60, 3)]], "node int")
    monkeypatch.setattr(G, "HELD", held)
    counted = G.trail_counts(edges, seeds, 3)
    assert dict(counted.dtypes)["target"] == "int" and Counter(map(tuple, counted.collect())) == listed_counts(edges, seeds)


def test_counts_of_trails_between_names(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "c", "c")], "edge_id long, src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert Counter(map(tuple, G.trail_counts(edges, seeds, 3).collect())) == listed_counts(edges, seeds)


@pytest.mark.parametrize("piece", [2, 250])
def test_steps_of_mentions_are_the_edges_both_ways(spark, monkeypatch, piece):
    monkeypatch.setattr(G, "PIECE", piece)
    rng = random.Random(6)
    m = spark.createDataFrame([(c, e) for c in range(9) for e in rng.choices(range(30), k=c + 1)] + [(None, 1), (1, None)], "chunk long, entity long")
    e = [(r.src, r.dst) for r in G.comention_edges(m).collect()]
    steps = G.comention_steps(m).select("node", F.explode("to").alias("to")).distinct()
    assert Counter(map(tuple, steps.collect())) == Counter(e + [(b, a) for a, b in e])


def test_packed_rows_come_back():
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    rows = [(5, [5]), (high, [low, -1, 0, 127, 128, high]), (low, [high]), (0, list(range(-300, 70_000, 7)))]
    keys, lens, to = np.array([k for k, _ in rows]), np.array([len(t) for _, t in rows]), np.concatenate([t for _, t in rows])
    for n in (np.ones(len(to), np.int64), np.where(to == 128, 1 << 40, 1)):
        b = T.packed(keys, lens, to, n)
        for part in (b, b.slice(1, 2)):
            lo = 1 if len(part) == 2 else 0
            i = slice(lens[:lo].sum(), lens[: lo + len(part)].sum())
            got = T.unpacked(part["node"].to_numpy(), part["to"], part["n"])
            assert np.array_equal(got[0], lens[lo : lo + len(part)]) and np.array_equal(got[1], to[i])
            assert np.array_equal(got[2], n[i]) if n.max() > 1 else got[2] is None
