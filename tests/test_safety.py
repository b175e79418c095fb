"""String ids, merges without loss, upserts that survive a stop, uploads and word-processor files."""

import pytest
from pyspark.sql import functions as F

from quillgraph import runtime
from quillgraph.operators import align as A
from quillgraph.operators import chunking as C
from quillgraph.operators import community as CM
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import service as S
from quillgraph.operators import vector as V
from quillgraph.plans import pipeline_queries as PQ
from quillgraph.sources import office as O
from quillgraph.sources import writers as WR


def test_string_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "t"), ("b", [1.0, 0.1], "t"), ("c", [1.0, 0.1], "t"), ("z", None, "t")], "id string, vector array<double>, type string")
    assert {r.id: r.near for r in V.nearest(v, v).collect()} == {"a": "b", "b": "c", "c": "b"}
    e = spark.createDataFrame([("x-1", "Omar", 2), ("x-2", "Omar A", 2), ("x-3", "Omar B", 2)], "id string, name string, mentions int")
    m = spark.createDataFrame([(f"x-{i}", "k") for i in (1, 2, 3)], "id string, cluster string")
    assert {r.canonical for r in A.canonical_map(m, e).collect()} == {"x-2"}
    p = spark.createDataFrame([("c", "p2"), ("c", "p1"), ("d", "p9")], "child string, parent string")
    assert {(r.child, r.parent, r.n) for r in M.plurality_parent(p).collect()} == {("c", "p1", 1), ("d", "p9", 1)}
    edges = spark.createDataFrame([(f"{g}{a}", f"{g}{b}", 1.0) for g in "xy" for a, b in ((0, 1), (1, 2), (0, 2))] + [("x0", "y0", 0.1)], "src string, dst string, weight double")
    h = CM.hierarchy(G.adjacency(edges), rounds=6, levels=1)
    got = {}
    for r in h[-1].collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [["x0", "x1", "x2"], ["y0", "y1", "y2"]]


def test_merge_keeps_aliases_and_chunks(spark):
    e = spark.createDataFrame([("a", "Bank A", ["A Bank"], 5), ("b", "Bank-A", ["The A"], 1), ("c", "Other", None, 1)], "id string, name string, aliases array<string>, mentions int")
    mention = spark.createDataFrame([("k1", "b"), ("k1", "a")], "chunk string, entity string")
    edge = spark.createDataFrame([("b", "T", "c", 1, ["k1"]), ("a", "T", "c", 2, ["k2", "k1"]), ("a", "T", "b", 1, ["k3"])], "src string, type string, dst string, weight int, chunkIds array<string>")
    got = A.merged(e, mention, edge, spark.createDataFrame([("a", "a"), ("b", "a")], "id string, canonical string"))
    assert {r.id: r.aliases for r in got["entities"].collect()} == {"a": ["A Bank", "Bank-A", "The A"], "c": []}
    assert [(r.src, r.dst, r.weight, r.chunkIds) for r in got["edges"].collect()] == [("a", "c", 3, ["k1", "k2"])]
    assert [tuple(r) for r in got["mentions"].collect()] == [("k1", "a")]


def test_a_stop_between_the_renames_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    WR.merge_into(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the job had stopped after the first rename
    WR.merge_into(spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")} and not (tmp_path / "t.old").exists()


def test_partitioned_upserts_leave_other_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    WR.merge_into(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, part string"), path, ["k"], partition="part")
    before = sorted(p.name for p in (tmp_path / "p" / "part=y").glob("*.parquet"))
    for _ in range(2):
        WR.merge_into(spark.createDataFrame([(1, "z", "x"), (3, "n", "x")], "k int, v string, part string"), path, ["k"], partition="part")
    assert {tuple(r) for r in spark.read.parquet(path).select("k", "v", "part").collect()} == {(1, "z", "x"), (2, "b", "y"), (3, "n", "x")}
    assert sorted(p.name for p in (tmp_path / "p" / "part=y").glob("*.parquet")) == before


def test_latest_version_counts(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, None, "x"), (1, 9, "new")], "k int, ver int, v string")
    assert {tuple(r) for r in WR.latest(df, ["k"], "ver").collect()} == {(1, 9, "new"), (2, None, "x")}
    assert WR.latest(df.limit(0), ["k"]).count() == 0


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, k, d: d
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Session())


def test_uploads_stay_in_their_folder(spark, tmp_path):
    assert WR.save_upload(spark, str(tmp_path), "../../etc/pass wd", b"x") == f"{tmp_path}/pass_wd" and (tmp_path / "pass_wd").read_bytes() == b"x"
    assert WR.save_upload(spark, str(tmp_path), "..", b"").endswith("/upload")


def test_word_files_and_sections(spark):
    files = spark.createDataFrame([("/in/A B.docx", bytearray(PQ._docx([("x", "y & z")]))), ("/in/bad.docx", bytearray(b"no"))], "path string, content binary")
    rows = {r.elementId: r for r in O.elements(O.docx_table(files)).collect()}
    assert [rows[f"a b-{i:04d}"].elementType for i in range(1, 6)] == ["heading", "heading", "paragraph", "table", "heading"]
    assert rows["a b-0004"].sectionPath == ["World", "Regions"] and rows["a b-0004"].text == "| x | y & z |" and rows["a b-0005"].sectionPath == ["End"]
    assert O.docx_table(files.limit(0)).count() == 0


def test_islands_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    path = lambda i: [["a"], ["a"], ["b"], ["b"], ["b"], ["a"], None, None][i % 8]
    rows = [("d" if i < 20 else None, path(i), 1, "paragraph", f"t{i}", f"{'d' if i < 20 else 'n'}-{i:04d}", None) for i in range(26)]
    df = spark.createDataFrame(rows + rows[:3], "docName string, sectionPath array<string>, page int, elementType string, text string, elementId string, accessLevel string")
    want, last, n = {}, {}, {}
    for d, p, _, _, _, i, _ in rows:
        if d not in last or last[d] != p:
            n[d] = n.get(d, 0) + 1
        last[d] = p
        want[i] = n[d]
    assert {r.elementId: r.island for r in C.section_islands(df).collect()} == want
    c = C.chunk_elements(df, budget=50).where("docName = 'd'").orderBy("chunkId").collect()
    assert [x for r in c for x in r.elementIds] == [r[5] for r in rows[:20]] and [r.chunkId for r in c] == [f"d-c{k:04d}" for k in range(1, len(c) + 1)]


def test_ranks_over_all_rows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 7, 7, None, 1, 9, 5, 5])], "id int, v int")
    assert {r.id: r["rank"] for r in M.rank_above(df, "v").collect()} == {0: 4, 1: 2, 2: 2, 3: None, 4: 7, 5: 1, 6: 4, 7: 4}


def test_hot_chunks_give_the_same_edges(spark, monkeypatch):
    m = spark.createDataFrame([(c, e) for c in range(3) for e in range(c, 12)], "chunk int, entity int")
    want = {tuple(r) for r in G.comention_edges(m).collect()}
    monkeypatch.setattr(G, "HOT", 5)
    assert {tuple(r) for r in G.comention_edges(m).collect()} == want and len(want) == 66


def test_chat_requests(spark):
    chats = spark.createDataFrame([("c1", "u", "t", None, None)], "id string, userId string, title string, createdAt timestamp, updatedAt timestamp")
    asked = spark.createDataFrame([("c1", "v", "again"), ("c2", "u", " " + "q" * 80)], "id string, userId string, question string")
    got = {r.id: (r.userId, r.title) for r in S.create_chats(chats, asked, F.current_timestamp()).collect()}
    assert got == {"c1": ("u", "t"), "c2": ("u", "q" * 60)}
    assert S.owned(chats, spark.createDataFrame([("x",)], "userId string")).count() == 0
    assert S.renamed(chats, spark.createDataFrame([("c1", " ")], "id string, title string")).first().title == "t"
