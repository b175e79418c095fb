import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking as C
from quillgraph.operators import crawl as CR
from quillgraph.operators import hooks as H
from quillgraph.operators import ner as N


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize("text,n", [("a  b\nc", 3), ("", 0), (None, 0), ("   ", 0)])
def test_count_tokens(spark, text, n):
    assert one(spark, text, X.count_tokens) == n


def test_expressions(spark):
    assert one(spark, "أُمٌّ  إلى", X.normalize_arabic) == "ام الي"
    assert one(spark, " Big  Bank ", X.slug) == "big-bank"
    assert one(spark, "--", X.link_name) == "LINKED_TO" and one(spark, "same name as", X.link_name) == "SAME_NAME_AS"
    assert one(spark, "x?pageNo=9&a", X.next_page) == "x?pageNo=10&a" and one(spark, "x", X.next_page) is None
    assert one(spark, "My account is 1234567890", X.has_pii) is True
    assert one(spark, "One. Two? ثلاثة؟ Four", X.sentences) == ["One.", "Two?", "ثلاثة؟", "Four"]
    assert one(spark, "abc", X.char_ngrams) == ["c2_ab", "c2_bc", "c3_abc"] and one(spark, "a", X.char_ngrams) == []


def test_sections(spark):
    md = "# A\n\ntext\n\n### C\n\n- x\n\n## B\n\n| t |"
    p = C.section_paths(spark.createDataFrame([(1, md), (2, None)], "k int, t string"), "k", "t").orderBy("pos").collect()
    assert [(r.kind, r.path) for r in p] == [("heading", ["A"]), ("paragraph", ["A"]), ("heading", ["A", "C"]), ("list", ["A", "C"]), ("heading", ["A", "B"]), ("table", ["A", "B"])]


def test_islands_and_chunks(spark):
    e = "docName string, sectionPath array<string>, page int, elementType string, text string, elementId string, accessLevel string"
    rows = [("d", ["S"], 1, "heading", "S", "d-0001", "internal"), ("d", ["S"], 1, "paragraph", "one two three", "d-0002", "internal"), ("d", ["S"], 2, "table", "| a |", "d-0003", "internal"), ("d", ["T"], None, "paragraph", "x y", "d-0004", None), ("d", ["S"], 3, "paragraph", None, "d-0005", None)]
    df = spark.createDataFrame(rows + rows[:2], e)
    assert [r.island for r in C.section_islands(df).orderBy("seq").collect()] == [1, 1, 2, 3]
    c = C.chunk_elements(df, budget=4).orderBy("chunkId").collect()
    assert [r.chunkId for r in c] == ["d-c0001", "d-c0002", "d-c0003"] and c[0].text == "S: one two three\n\n| a |" and c[0].pages == [1, 2]
    assert C.chunk_elements(df.limit(0)).count() == 0


def test_packing_keeps_everything():
    rng = random.Random(1)
    for _ in range(50):
        els = [(str(i), rng.choice(["paragraph", "table"]), " ".join(["w"] * rng.randint(0, 30)) + ".") for i in range(rng.randint(0, 12))]
        got = C.pack_section(els, 20)
        assert [i for g in got for i, _, _ in g] == [i for i, _, _ in els]
        for g in got:
            words = sum(len(t.split()) for _, k, t in g if k != "table")
            assert words <= 20 or len([1 for _, k, _ in g if k != "table"]) == 1


def test_split_and_tail():
    assert C.split_long("a b\nc d\ne f", 4) == ["a b\nc d", "e f"]
    assert C.split_long("One two. Three four. Five", 4) == ["One two. Three four.", "Five"]
    assert C.tail_of("A b c. D e. F", 3) == "D e. F"


def test_table_text(spark):
    cells = [("t", 0, 0, "Name", True), ("t", 0, 1, "Age", True), ("t", 1, 0, "Ann", False), ("t", 1, 1, "5", False), ("t", 2, 0, "Bob", False), ("t", 2, 1, "", False), ("u", 0, 0, "k", False), ("u", 0, 1, "v", False), ("u", 0, 2, "w", False), ("u", 1, 0, "z", False)]
    got = {r.table_id: r.text for r in C.table_text(spark.createDataFrame(cells, "table_id string, row int, col int, text string, header boolean")).collect()}
    assert got == {"t": "Name: Ann, Age: 5\nName: Bob", "u": "k: v, w, z"}


def test_bio(spark):
    t = N.word_offsets(spark.createDataFrame([("c", ["the", "Big", "Bank", "x"])], "k string, w array<string>"), "k", "w")
    l = N.bio_labels(t, spark.createDataFrame([("c", 4, 12)], "k string, start int, end int"), "k")
    assert [r.label for r in l.orderBy("i").collect()] == ["O", "B", "I", "O"]
    assert [tuple(r) for r in N.bio_spans(l, "k").select("start", "end", "text").collect()] == [(4, 12, "Big Bank")]
    assert [x.word for x in spark.createDataFrame([("م 12-3-4 a.",)], "t string").select(N.exact_tokens("t").alias("x")).first().x] == ["م", "12-3-4", "a", "."]


def test_sentence_islands(spark):
    lines = [(i, v) for i, v in enumerate(["a B", "b O", "", "c O", ""])]
    assert [(r.sentence, r.word, r.label) for r in N.sentence_islands(spark.createDataFrame(lines, "n long, value string")).orderBy("n").collect()] == [(0, "a", "B"), (0, "b", "O"), (1, "c", "O")]


def test_hooks(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return H.hashed_embedding(texts)

    assert [v is None for v in H.with_skips(["a", "bad", "c"], picky)] == [False, True, False]
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string")
    assert H.embedded(df, "k", "t").where("size(vector) = 64").count() == 2
    assert H.pending(df, df.limit(1), "k").count() == 1
    assert [r.type for r in H.gazetteer_spans(df, "k", "t", {"T": ["b"]}).collect()] == ["T"]
    assert H.batched(df, "k", "t", lambda v: 1 / 0).where("error is not null").count() == 2 and H.route("Summarise the main themes") == "global"


def test_crawl(spark):
    pages = spark.createDataFrame([("http://h/a/", '<a href="b.html">B</a> <A HREF="/f/x%20y.pdf?v=1#p"><b>File</b></A> <a href="http://h/a/?pageNo=2">next</a>'), ("http://h/a/b.html", '<a href="../c">C</a>')], "url string, html string")
    l = CR.links(pages)
    assert {r.href for r in l.collect()} >= {"http://h/a/b.html", "http://h/f/x%20y.pdf?v=1"}
    d = CR.documents_of(l).first()
    assert (d.title, d.file) == ("File", "x_y.pdf")
    assert CR.crawl(l, pages.limit(1), 1).count() >= 2
