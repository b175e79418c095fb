import json

from pyspark.sql import functions as F

from quillgraph.sources import readers as RD
from quillgraph.sources import writers as WR
from quillgraph.streaming import jobs as J


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "doc1.json").write_text(json.dumps([{"docName": "d", "elementId": "d-0001", "text": "نص"}], ensure_ascii=False, indent=1))
    e = RD.json_arrays(spark, str(tmp_path / "*.json"), RD.ELEMENT).first()
    assert (e.text, e.file, e.page) == ("نص", "doc1", None)
    (tmp_path / "n.csv").write_text("node_id,name,countries\n1,A,EG\n2,,\n,B,\n")
    (tmp_path / "e.csv").write_text("node_id_start,node_id_end,link\n1,2,\n1,,x\n")
    assert {tuple(r) for r in RD.graph_nodes(spark, {"Entity": str(tmp_path / "n.csv")}).collect()} == {("1", "A", "EG", "Entity"), ("2", "2", "", "Entity")}
    assert [tuple(r) for r in RD.graph_edges(spark, str(tmp_path / "e.csv")).collect()] == [("1", "2", "linked to")]


def test_questions_and_files(spark, tmp_path):
    p = {"title": "t", "paragraph_text": "same", "is_supporting": True}
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "2hop_1", "question": "q", "answer": "a", "paragraphs": [p, p]}) + "\n\n")
    q, c = RD.questions(spark, str(tmp_path / "q.jsonl"))
    assert q.where("hop = '2hop'").count() == 1 and c.count() == 1
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.zzz").write_text("?")
    f = RD.binary_files(spark, str(tmp_path / "*.*"))
    assert RD.plain_pages(f).first().markdown == "# x" and f.where("route is null").count() >= 1
    assert RD.recognised(f.where("route = 'text'"), lambda b: [b.decode(), "2"]).count() == 2


def test_merge_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    WR.merge_into(a, path, ["k"])
    for _ in range(2):
        WR.merge_into(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    WR.merge_into(spark.createDataFrame([(3, "z"), (4, "e")], "k int, v string"), path, ["k"], prefer_new=False)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d"), (4, "e")}
    assert WR.duplicate_keys(a, "k").count() == 0


def test_partitions_and_dumps(spark, tmp_path):
    p = str(tmp_path / "e")
    WR.overwrite_partitions(spark.createDataFrame([(1, "x"), (2, "y")], "v int, type string"), p, "type")
    WR.overwrite_partitions(spark.createDataFrame([(3, "y")], "v int, type string"), p, "type")
    assert {tuple(r) for r in spark.read.parquet(p).select("v", "type").collect()} == {(1, "x"), (3, "y")}
    m = WR.markdown_of(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "docName string, page int, markdown string")).first()
    assert m.markdown == "a\n\n---\n\nb"


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("c", "word " * 600), ("c", "word " * 600), ("d", "x")], "chatId string, content string")
    df.coalesce(1).write.parquet(src)
    q = J.due_summaries(J.files(spark, src, df.schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("c", 2, 1200)]
    a = spark.createDataFrame([("m", "one two", [("x",)])], "id string, content string, citations array<struct<chunkId: string>>")
    e = J.token_events(a)
    assert [r.type for r in e.orderBy("seq").collect()] == ["citations", "token", "token", "done"]
    assert J.parsed_frames(J.event_frames(e)).where(F.col("type") == "token").count() == 2
