"""Queries over the whole graph against brute force on small tables, where nearly all edges have weight 1."""

import random
from collections import Counter
from itertools import combinations

import pytest

from quillgraph.plans import graph_queries as GQ
from quillgraph.plans import metric_queries as MQ
from quillgraph.plans import vector_queries as VQ

rng = random.Random(4)
ORDERS = {o: rng.sample(range(1, 61), 3) for o in range(40)} | {o: rng.sample([100, 200, 300, *range(1, 61)], 3) for o in range(40, 60)} | {60: [400, 401], 61: [401, 402]}
VECTORS = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(70)}
WEIGHT = Counter(p for parts in ORDERS.values() for p in combinations(sorted(parts), 2))
NEAR = {}
for a, b in WEIGHT:
    NEAR.setdefault(a, set()).add(b)
    NEAR.setdefault(b, set()).add(a)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(o, p) for o, parts in ORDERS.items() for p in parts * 2], "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(1, 403)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(list(VECTORS.items()), "vec_id long, embedding array<float>").selectExpr("*", "1 as label").write.parquet(f"{d}/embeddings.parquet")
    return d


def trails(seeds, depth):
    cur, out = [((s,), ()) for s in seeds], []
    for _ in range(depth):
        cur = [((*n, x), (*e, frozenset((n[-1], x)))) for n, e in cur for x in NEAR.get(n[-1], ()) if frozenset((n[-1], x)) not in e]
        out += [n for n, _ in cur]
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_most_edges_are_light():
    assert sum(w == 1 for w in WEIGHT.values()) > 0.9 * len(WEIGHT)


def test_neighbours_and_hops(spark, tables):
    assert rows(GQ.one_hop_neighbours(spark, tables)) == Counter((a, b) for a in NEAR for b in NEAR[a])
    assert rows(GQ.neighbour_degree_range(spark, tables)) == Counter((a, len(n)) for a, n in NEAR.items() if 5 <= len(n) <= 50)
    h0 = {100, 200, 300, 400}
    h1 = {x for s in h0 for x in NEAR.get(s, ())} - h0
    h2 = {x for s in h1 for x in NEAR[s]} - h0 - h1
    assert rows(GQ.khop_subgraph(spark, tables)) == Counter([(x, h, t) for h, t, s in ((0, "seed", h0), (1, "1", h1), (2, "2+", h2)) for x in s])
    assert rows(GQ.induced_edges(spark, tables)) == Counter((a, b, w) for (a, b), w in WEIGHT.items() if {a, b} <= h0 | h1)


def test_trails(spark, tables):
    seeds = [100, 200, 300, 400]
    assert rows(GQ.trail_paths_depth2(spark, tables)) == Counter((n[0], n[-1], len(n) - 1, ">".join(map(str, n))) for n in trails(seeds, 2))
    want = Counter((n[0], n[-1], len(n) - 1) for n in trails(seeds, 3))
    assert rows(GQ.trail_paths_depth3(spark, tables)) == Counter((*k, n) for k, n in want.items())


def test_components(spark, tables):
    part = {}
    for n in sorted(NEAR):
        todo = [] if n in part else [n]
        while todo:
            x = todo.pop()
            if x not in part:
                part[x] = n
                todo += NEAR[x]
    sizes = Counter(part.values())
    assert rows(GQ.part_components(spark, tables)) == Counter((c, n, max(x for x in part if part[x] == c)) for c, n in sizes.items())


def test_communities_get_the_whole_graph(spark, tables, monkeypatch):
    def hierarchy(adj, **limits):
        assert not limits and rows(adj) == Counter((*e, float(w)) for (a, b), w in WEIGHT.items() for e in ((a, b), (b, a)))
        return [adj.selectExpr("src as node", "1L as label").distinct()]

    monkeypatch.setattr(MQ.CM, "hierarchy", hierarchy)
    assert rows(MQ.leiden_hierarchy(spark, tables)) == Counter([(0, 1, len(NEAR))])


def test_retrieval(spark, tables):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    score = {i: cosine(v, VECTORS[VQ.QUERY_ID]) for i, v in VECTORS.items()}
    chunks = {}
    for o, parts in ORDERS.items():
        for p in parts:
            chunks.setdefault(p, set()).add(o)

    def best(paths):
        out = {}
        for n in paths:
            known = [score[x] for x in n if x in score]
            s = sum(known) / len(known) if known else 0
            for c in (c for x in n for c in chunks[x] if s > 0):
                out[c] = max(out.get(c, 0), s)
        return out

    near = best(trails(sorted(score, key=lambda i: (-score[i], i))[:8], 2))
    assert {r.chunk: r.score for r in VQ.khop_retrieval(spark, tables).collect()} == pytest.approx({c: near[c] for c in sorted(near, key=lambda c: (-near[c], c))[:20]}, abs=1e-5)
    assert {r.chunk: r.score for r in VQ.path_scores_chunk_max(spark, tables).collect()} == pytest.approx(best(trails([100, 200, 300, 400], 2)), abs=1e-5)
