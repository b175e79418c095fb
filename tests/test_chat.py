from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import chat as C
from quillgraph.operators import metrics as M

T = datetime(2024, 1, 1)


def said(spark, *texts):
    return spark.createDataFrame([("u", "c", str(i), T + timedelta(minutes=i), t) for i, t in enumerate(texts)], "userId string, chatId string, id string, createdAt timestamp, content string")


@pytest.mark.parametrize(
    "text,want",
    [
        ("always answer in Arabic", ("preference", "language", "Arabic")), ("answer in english from now on", ("preference", "language", "english")), ("I prefer concise answers", ("preference", "verbosity", "concise")),
        ("my role is Compliance Analyst", ("profile", "role", "Compliance Analyst")), ("always include page numbers in responses", ("instruction", "always_include", "page numbers")), ("never mention internal codenames", ("instruction", "never_include", "mention")),
    ],
)
def test_promotions(spark, text, want):
    assert want in {(r.category, r.key, r.value) for r in C.promotions(said(spark, text)).collect()}


def test_private_numbers_block(spark):
    assert C.promotions(said(spark, "always answer in Arabic. my account is 1234567890123", None)).count() == 0


def test_promoted_state(spark):
    found = C.promotions(said(spark, "I prefer brief answers", "I prefer concise answers"))
    r = C.promoted(found).first()
    assert (r.value, r.source) == ("concise", "inferred") and r.confidence == pytest.approx(0.75)
    explicit = spark.createDataFrame([("u", "preference", "verbosity", "verbose", "explicit", 1.0)], "userId string, category string, key string, value string, source string, confidence double")
    k = C.promoted(found, explicit).first()
    assert (k.value, k.source, k.confidence) == ("verbose", "explicit", 1.0)


def messages(spark, n):
    return spark.createDataFrame([("c", f"m{i}", T + timedelta(minutes=i), f"msg {i}", "user") for i in range(n)], "chatId string, id string, createdAt timestamp, content string, role string")


def test_recent_and_since(spark):
    m = messages(spark, 8)
    assert [r.content for r in C.recent_messages(m, 4).orderBy("pos").collect()] == ["msg 4", "msg 5", "msg 6", "msg 7"]
    mark = lambda v: spark.createDataFrame([("c", v)], "chatId string, sinceId string")
    assert [C.messages_since(m, mark(v)).count() for v in ("m5", None, "nope")] == [2, 8, 0]
    assert C.summary_due(m).first().due and not C.summary_due(messages(spark, 5)).first().due
    assert C.recent_messages(m.limit(0), 4).count() == 0


def test_prompt_order(spark):
    p = spark.range(1).select(C.assembled(F.lit("MEM"), F.lit("SUM"), F.lit("HIST"), F.lit("CTX"), F.lit("REM"), F.lit("Q"), F.lit("SYS")).alias("p")).first().p
    assert p == "SYS\n\nMEM\n\nSUM\n\nHIST\n\nCTX\n\nREM\n\nQ"
    assert spark.range(1).select(C.assembled(F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("x"), F.lit(""), F.lit("Q"), F.lit("S")).alias("p")).first().p == "S\n\nx\n\nQ"


def test_cascade(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    chats = spark.createDataFrame([("c1", "u1"), ("c2", "u2")], "id string, userId string")
    msgs = spark.createDataFrame([("m1", "c1"), ("m2", "c2")], "id string, chatId string")
    cits = spark.createDataFrame([("x", "m1"), ("y", "m2")], "id string, messageId string")
    audit = spark.createDataFrame([("u1",), ("u2",), (None,)], "userId string")
    out = C.cascade_delete(ids("u1", "u2"), chats, msgs, cits, audit, ids("u1"))
    assert {k: v.count() for k, v in out.items()} == {"users": 1, "chats": 1, "messages": 1, "citations": 1, "audit": 3}
    assert out["audit"].where("userId is not null").count() == 1


def test_metrics(spark):
    got = M.ranking_metrics(spark.createDataFrame([("q", "c1", 1), ("q", "x", 2), ("q", "c2", 3)], "query string, item string, rank int"), spark.createDataFrame([("q", "c1"), ("q", "c2")], "query string, item string"), 2).first()
    assert (got.recall, got.precision, got.mrr) == (0.5, 0.5, 1.0)
    same = spark.createDataFrame([(i % 2, i % 2) for i in range(6)], "a int, b int")
    r = M.agreement(same).first()
    assert r.nmi == pytest.approx(1) and r.ari == pytest.approx(1)
    assert M.agreement(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).first().nmi == 1.0
    z = M.span_prf(spark.createDataFrame([], "k int"), spark.createDataFrame([], "k int"), ["k"]).first()
    assert (z.tp, z.precision, z.f1) == (0, 0.0, 0.0)
