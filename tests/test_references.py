from datetime import datetime

from quillgraph.operators import references as R

CIT = "id string, messageId string, chunkId string, createdAt timestamp, extra int"
T = datetime(2024, 5, 1)


def found(spark, cits, chunks, messages=(), audit=()):
    return {
        tuple(r)
        for r in R.orphan_references(
            spark.createDataFrame(cits, CIT), spark.createDataFrame([(c, "d", 1) for c in chunks], "chunkId string, docName string, id int"), spark.createDataFrame([(m, 1) for m in messages], "id string, createdAt int"),
            spark.createDataFrame(list(audit), "action string, entityType string, entityId string, createdAt timestamp"),
        ).collect()
    }


def test_runs_and_asof_match_brute_force(spark):
    keys = [f"d-c{n:04d}" for n in (1, 2, 3, 5, 63, 64, 65, 200)] + ["plain", "d-c1"]
    runs = R.parent_runs(spark.createDataFrame([(k,) for k in keys + keys[:3] + [None]], "k string"), R.F.col("k"))
    refs = [f"d-c{n:04d}" for n in range(210)] + ["plain", "plainer", "d-c1", "d-c2", None]
    got = {r.k: r.present for r in R.match_runs(spark.createDataFrame([(k,) for k in refs], "k string"), R.F.col("k"), runs).collect()}
    assert got.pop(None) is None
    assert got == {k: k in keys for k in refs if k is not None}


def test_kinds(spark):
    cits = [("a", "m1", " D-C0001 ", T, 0), ("b", "m9", "d-c0002", T, 0), ("c", None, "d-c0003", T, 0), ("d", "m1", None, T, 0), ("e", "m1", "x-c0001", T, 0), ("a", "m1", " D-C0001 ", T, 0)]
    audit = [("Delete", "chunk", "D-c0002", T), ("ingest", "document", "d", datetime(2024, 6, 1)), ("reingest", "chunk", "d-c0003", datetime(2024, 4, 1)), ("view", "chunk", "x-c0001", T)]
    assert found(spark, cits, ["d-c0001", "d-c0003"], ["m1"], audit) == {("a", "chunks", "2024-05", "late"), ("b", "chunks", "2024-05", "deleted"), ("b", "messages", "2024-05", "missing"), ("e", "chunks", "2024-05", "missing")}


def test_empty_tables_and_null_times(spark):
    assert found(spark, [], ["d-c0001"]) == set()
    assert found(spark, [("a", None, "q", None, 1)], []) == {("a", "chunks", None, "missing")}
