"""Names, packing, mixing and token counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing as MI
from quillgraph.llm import names as NA
from quillgraph.llm import packing as PK
from quillgraph.llm import tokens as TK

TASK = "data struct<text: string>, meta struct<chunkId: string>, predictions array<struct<model_version: string, result: array<struct<id: string, value: struct<start: int, end: int, text: string, labels: array<string>>>>>>, id int"


def groups(spark, texts):
    out = {}
    for r in NA.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        out.setdefault(r.cluster, set()).add(r.text)
    return {frozenset(v) for v in out.values()}


def test_entities(spark):
    want = [
        {"Catherine Zuvorafi", "C. Zuvorafi", "Zuvorafi, Catherine", "CATHERINE ZUVORAFI", "Dr. Kate Zuvorafi", "Catherine Zvorafi"}, {"Nicholas Zuvorafi", "Nick Zuvorafi"},
        {"Fazapono Cooperative Export Leasing", "Fazapono CEL S.A.E.", "The Fazapono Co-op Exp. Lsg SAE", "Cooperative Export Leasing of Fazapono"}, {"Fazapono National Fund Limited", "FAZAPONO NATIONAL FUND LTD"},
        {"بنك خحيعيجي العقاري", "البنك العقاري خحيعيجي", "بنك «خحيعيجي» العقاري"}, {"أسامة الدانالوز", "أسامه الدانالوز", "الدانالوز، أسامة"},
    ]
    assert groups(spark, sorted(set().union(*want))) == {frozenset(w) for w in want}


def test_span_pairs(spark):
    span = lambda i, t, *l: {"id": i, "value": {"start": 0, "end": 1, "text": t, "labels": list(l)}}
    res = lambda *s: [{"model_version": None, "result": list(s)}]
    tasks = [
        ({"text": "x"}, None, res(span("a", "Omar Suletama", "Person"), span("b", "Umar Suletama", "Law"), span("n", None), span("t", "account files", "Person"), span("u", "account files", "FinancialInstrument"))), ({"text": "x"}, None, res(span("c", "Omar Suletama", "Person"))), ({"text": "y"}, None, None), ({"text": "z"}, None, []),
    ]
    got = {tuple(r) for r in NA.same_entity_pairs(spark.createDataFrame([(*t, 1) for t in tasks + tasks[:1]], TASK)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert NA.same_entity_pairs(spark.createDataFrame([], TASK)).count() == 0


def test_similar_words_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("bdkmr") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:20]}
    df = spark.createDataFrame([("k", w, 1) for w in words], "kind string, word string, n int")
    got = {(r.a, r.b): r.cosine for r in NA.similar_words(df).collect()}
    def unit(lengths):
        grams = {w: {f"^{w}$"[i : i + n] for n in lengths for i in range(len(w) + 3 - n)} for w in words}
        df_ = Counter(g for v in grams.values() for g in v)
        wt = {g: math.log((len(words) + 1) / n) for g, n in df_.items()}
        norm = {w: math.sqrt(sum(wt[g] ** 2 for g in v)) for w, v in grams.items()}
        return lambda a, b: sum(wt[g] ** 2 for g in grams[a] & grams[b]) / (norm[a] * norm[b])

    short, long = unit((2, 3)), unit((4,))
    less = {w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for w in words}
    every = {(a, b): short(a, b) for a in words for b in words if a < b and short(a, b) >= NA.COSINE}
    assert all(got[k] == pytest.approx(every[k]) for k in got)
    # all that meet on a 4-gram vector above the threshold, or one letter apart, must be there
    assert {k for k in every if long(*k) >= NA.COSINE or less[k[0]] & less[k[1]]} <= set(got)


def greedy(n, sims, least):
    groups = {i: [i] for i in range(n)}
    while True:
        best = max(((sum(sims.get((min(x, y), max(x, y)), 0.0) for x in groups[i] for y in groups[j]) / (len(groups[i]) * len(groups[j])), i, j) for i in groups for j in groups if i < j), default=(0, 0, 0))
        if best[0] < least:
            return {frozenset(g) for g in groups.values()}
        groups[best[1]] += groups.pop(best[2])


def test_linkage_equals_greedy_merges(spark):
    rng = random.Random(8)
    sims = {(i, j): rng.random() for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.25}
    links = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "a long, b long, s double")
    nodes = spark.createDataFrame([(i,) for i in range(31)], "key long")
    for least in (0.2, 0.5):
        got = {}
        for r in NA.average_linkage(nodes, links, least).collect():
            got.setdefault(r.cluster, set()).add(r.key)
        assert {frozenset(g) for g in got.values()} == greedy(31, sims, least)
    assert NA.average_linkage(nodes, links.limit(0)).where("key != cluster").count() == 0


def test_word_cosines():
    assert NA.edits("abcd", "abdc") == 1 and NA.edits("abcd", "acd") == 1 and NA.edits("abc", "xyz", 2) == 3
    assert NA.word_cosine("omar", "omar") == 1 and NA.word_cosine("o", "omar") > 0.4 and NA.word_cosine("omar", "=om") == 0 and NA.word_cosine("daniel", "victoria") < 0.1
    assert NA.word_cosine("حماده", "محمد") > 0.5
    assert NA.around_cosine(["maritime", "bank"], ["=mb"]) == NA.ACRONYM and NA.around_cosine([], ["omar"]) == 0 == NA.around_cosine(["=mb"], ["=mf"])
    assert NA.around_cosine(["maritime", "bank"], ["export", "bank"]) < NA.LINK < NA.around_cosine(["maritime", "bank"], ["martime", "bank"])


def test_packing(spark):
    rng = random.Random(6)
    rows = [("g", i // 40, f"i{i}", rng.choice("abc"), rng.choice([0, 5, 90, 200, 300, 1300])) for i in range(200)] + [("g", 0, "i0", "a", None), (None, None, None, None, -5)]
    out = PK.containers(spark.createDataFrame([(*r, 1) for r in rows], "grp string, lane long, item string, source string, tokens long, container int"), 512).collect()
    assert all(0 <= r.used <= 512 and r.used == sum(i.tokens for i in r["items"]) for r in out)
    want = Counter()
    for _, _, i, _, t in rows:
        want[i or "none"] += max(t or 0, 0)
    got, pieces = Counter(), Counter()
    for r in out:
        for i in r["items"]:
            got[i.item] += i.tokens
            pieces[i.item, i.piece] += 1
    assert got == want and all(i[1] == 0 for i in pieces if want[i[0]] <= 512)
    assert sum(r.fill for r in out if r.grp == "g") / sum(1 for r in out if r.grp == "g") > 0.9
    assert PK.containers(spark.createDataFrame([], "grp string, lane long, item string, source string, tokens long")).count() == 0


def test_windows_follow_the_shares():
    items = [(f"a{i}", "a", 64) for i in range(80)] + [(f"b{i}", "b", 64) for i in range(80)]
    for w in PK.pack_lane(items, {}, {"a": 0.5, "b": 0.5}, 512):
        assert Counter(s for _, _, s, _ in w) == {"a": 4, "b": 4}
    first = PK.pack_lane(items, {"a": 512.0, "b": -512.0}, {"a": 0.5, "b": 0.5}, 512)[0]
    assert {s for _, _, s, _ in first} == {"a"}


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["word"] * rng.randint(1, 40)), rng.choice(["A", " a", "b", "c", None, "other"])) for i in range(600)] + [(900, None, "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, copies int")
    mix, report = MI.mixture(df, targets)
    m, r = mix.collect(), {x.source: x for x in report.collect()}
    most = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= x.copies <= most[x.source] for x in m) and len({x.doc_id for x in m}) == len(m)
    for s, x in r.items():
        assert x.reached_tokens <= x.budget < x.reached_tokens + 60 and abs(x.reached_share - x.target_share) < 0.02
        assert sum(y.tokens * y.copies for y in m if y.source == s) == x.reached_tokens
    again = {(x.doc_id, x.copies) for x in MI.mixture(df.repartition(7), targets)[0].collect()}
    assert again == {(x.doc_id, x.copies) for x in m}
    assert MI.mixture(df.limit(0), targets)[0].count() == 0 and MI.mixture(df, targets.limit(0))[0].count() == 0


def test_tokens(spark):
    e = TK.encoding(TK.VOCABULARY)
    texts = ["Hello world", "بنك", "", None, "<|endoftext|>"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", TK.token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(e.encode_ordinary(t or "")) for t in texts] and got[4] > 1


def test_undotted_acronyms_are_organisations(spark):
    for brand, short, long in (("Thebiweli", "CEIC", "Commercial Export Insurance Company"), ("Yuhasohi", "CMF", "Commercial Maritime Fund"), ("Rishisheju", "AB", "Agricultural Bank")):
        assert NA.parse(f"{brand} {short}") == NA.parse(f"{brand} {'.'.join(short)}.") == ("org", [brand.lower(), "=" + short.lower()])
        assert NA.parse(f"{brand} {long}")[0] == "org"
    assert [NA.parse(t)[0] for t in ("Ahmed OMAR", "Dr. Salem AMIN", "J. Webu SAD", "AHMED HASSAN", "Daniel Guverelo JR")] == ["person"] * 5
    got = {r.text: r.cluster for r in NA.clusters(spark.createDataFrame([("Thebiweli CEIC",), ("Thebiweli C.E.I.C.",), ("Thebiweli Commercial Export Insurance Company",)], "text string")).collect()}
    assert len(set(got.values())) == 1


def test_windows_follow_target_shares(spark):
    rng = random.Random(2)
    rows = [("g", i // 500, f"i{i}", rng.choice("aab"), rng.randint(5, 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "grp string, lane int, item string, source string, tokens int")
    r = PK.fill_report(PK.containers(df)).first()
    assert r.share_error < 0.05 and r.mean_fill > 0.93 and r.tokens == sum(x[4] for x in rows)
    even = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("z", 1.0), (None, None)], "source string, share double")
    early = PK.containers(df, 512, even).where("container like 'g#0-0000%' and container < 'g#0-00008'").collect()
    part = [sum(x.tokens for x in c["items"] if x.source == "a") / c.used for c in early]
    assert all(abs(p - 0.5) < 0.1 for p in part)
    none = PK.fill_report(PK.containers(df.limit(0)))
    assert none.count() == 0
