"""Entity queries over all parts against plain loops."""

from collections import Counter

import pytest

from quillgraph.plans import entity_queries as EQ

NAMES = {1: "Red Bolt", 2: "blue nut", 3: "Green Pin", 51: "red bolt", 60: "Grey Cog"}
LINES = [(10, 1, 1, "A", 1), (11, 1, 2, "A", 2), (12, 2, 3, "R", 3), (13, 1, 2, "N", 4), (13, 2, 60, "A", 7), (14, 2, 51, "A", 1), (14, 2, 51, "A", 2), (15, 2, 51, "A", 6), (15, 1, 2, "A", 5)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(list(NAMES.items()), "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(1, "Supplier One", 0), (2, "Supplier Two", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, "EGYPT")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    return d


def test_triples_know_all_parts(spark, tables):
    least = {}
    for k, n in sorted(NAMES.items()):
        least.setdefault(n.lower(), f"p{k}")
    want, said = Counter(), {}
    for _, s, p, flag, line in LINES:
        if line < 5:
            e = (f"s{s}", least[NAMES[p].lower()])
            want[e] += 1
            said.setdefault(e, set()).add(flag)
    got = {(r.src, r.dst): (r.weight, r.predicates) for r in EQ.triple_edges(spark, tables).collect()}
    assert got == {e: (n, "|".join(sorted(said[e]))) for e, n in want.items()}
    assert tuple(EQ.triple_drop_counts(spark, tables).first().asDict()[c] for c in ("raw", "unmatched", "self_ref")) == (9, 2, 1)
    assert {r.surface for r in EQ.orphan_endpoints(spark, tables).collect()} == {"red", "egypt"}
    assert [tuple(r) for r in EQ.token_subset_match(spark, tables).collect()] == [("red", 1, "red bolt")]


def test_all_edges_are_merged(spark, tables):
    want = {}
    for o, s, p, flag, _ in LINES:
        want.setdefault((f"s{s}", flag, f"p{p}"), set()).add(o)
    got = {(r.src, r.predicate, r.dst): r.chunkIds for r in EQ.edge_upsert_chunkids(spark, tables).collect()}
    assert got == {k: "|".join(map(str, sorted(v))) for k, v in want.items()}
