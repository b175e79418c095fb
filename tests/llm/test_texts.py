"""Look-alikes, scan noise, leakage and quality on small inputs, against brute force where it applies."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import leakage as LE
from quillgraph.llm import lookalikes as LA
from quillgraph.llm import quality as QU
from quillgraph.llm import scans as SC

VARIANTS = ["café", "café", "ca​fé", "cаfе́", "ｃａｆｅ́", "cafe", "CAFÉ", "", None, "...", "ậ", "ậ", "ậ", "́x", "ﷺ", "لا", "ﻻ", "x" * 5000 + "é"]


def reference(t):
    out = unicodedata.normalize("NFKD", "".join(LA.OTHER.get(c, c) for c in t if LA._target(c) or unicodedata.combining(c)))
    out = "".join(LA.OTHER.get(c, LA.GREEK.get(c, LA.CYRILLIC.get(c, c))) for c in out)
    return unicodedata.normalize("NFC", out)


def test_one_form_equals_brute_force(spark):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(VARIANTS)], "id int, text string, canon string")
    got = {r.id: r.canon for r in LA.normalise(df, "text", "canon").collect()}
    assert got == {i: None if v is None else reference(v) for i, v in enumerate(VARIANTS)}


def test_pairs_differ_but_look_the_same(spark):
    rows = [(f"k{i:02d}", v, i) for i, v in enumerate(VARIANTS)] + [("k00", "café", 99), ("zz", "café", 1), (None, "café", 0)]
    got = {tuple(r) for r in LA.same_looking(spark.createDataFrame(rows, "id string, text string, raw int"), "id", "text").collect()}
    texts = {(k, v) for k, v, _ in rows if k and v and any(c.isalnum() for c in v)}
    want = {(a, b) for a, x in texts for b, y in texts if a < b and x != y and reference(x) == reference(y)}
    assert got == want and ("k00", "k01") in got and ("k00", "zz") not in got


def test_hangul_in_syllables_and_letters(spark):
    rows = [("a", "한글 글"), ("b", unicodedata.normalize("NFD", "한글 글")), ("c", "한글 굴")]
    got = {tuple(r) for r in LA.same_looking(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got == {("a", "b")}


def test_empty_tables(spark):
    assert LA.same_looking(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0
    assert LE.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, question string, paragraph_text string")).count() == 0
    assert QU.not_prose(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert SC.noise(spark.createDataFrame([], "docName string, page int, elementType string, elementId string, text string")).count() == 0


WORDS = [f"w{i}x" for i in range(400)]


def test_chain_against_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(40):
        text = [rng.choice(WORDS) for _ in range(80)]
        part = text[10:60]
        for i in rng.sample(range(5, 45), 3):
            part[i] = "other"
        doc = [rng.choice(WORDS) for _ in range(50)] + part[:25] + [rng.choice(WORDS) for _ in range(30)] + part[25:] + [rng.choice(WORDS) for _ in range(20)]
        code = {w: i for i, w in enumerate({*text, *doc})}
        a, b = np.array([code[w] for w in doc]), np.array([code[w] for w in text])
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert 38 <= LE.chained_words(a, b) <= lcs[-1][-1]


def test_leaks(spark):
    rng = random.Random(5)
    para = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(3)]
    ques = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(3)]
    items = [(i, ques[i], para[i], "t") for i in range(3)] + [(7, None, "", None)]
    w = para[0].split()
    docs = [(1, "intro " * 30 + " ".join(w[:30]).upper().replace(" ", ",\n"), 1), (2, " ".join(w[:18]) + " " + "filler " * 40, 2), (3, "see " + ques[1] + "?", 3), (4, None, 4), (5, " ".join(w[:15] + ["new"] * 12 + w[15:32]), 5), (6, "", 6)]
    got = {tuple(r) for r in LE.leaks(spark.createDataFrame(docs + docs[:1], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, question string, paragraph_text string, text string")).collect()}
    assert got == {(1, 0), (3, 1), (5, 0)}


def test_word_hashes_and_seeds_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = [None, "", "...", "One,\ntwo ONE", "كِتَابٌ كتاب أمر امر مسؤول مسوول شئ", "İx i\u0307x ΟΔΟΣ οδος", "soft\u00adware software", "word " * 40] + [" ".join(rng.choice(WORDS[:9]) for _ in range(n)) for n in (10, 11, 12, 60, 60, 60)] + [None]
    marks = re.compile("[\u0610-\u061a\u0640\u064b-\u065f\u0670\u0621\u00ad\u200b-\u200f\u2060\ufeff]")
    words = [re.findall(r"(?:[^\W_]|[\u0300-\u036f])+", marks.sub("", (t or "").lower()).translate(str.maketrans("أإآٱؤئىς", "ااااوييσ"))) for t in texts]
    monkeypatch.setattr(LE, "_BLOCK", 100)
    h, at = LE.word_hashes(pa.array(texts, pa.string()))
    flat = [w for ws in words for w in ws]
    assert np.diff(at).tolist() == [len(ws) for ws in words] and len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    picks = [{(m, *(ws[i + k] for k in mask)) for m, mask in enumerate(LE.MASKS) for i in range(len(ws) - LE.SPAN + 1)} for ws in words]
    seeds = LE.seed_hashes(h, at).to_pylist()
    assert [len(s) for s in seeds] == [len(set(s)) for s in seeds] == [len(p) for p in picks]
    assert len(set().union(*seeds)) == len(set().union(*picks)) and all(len({*a} & {*b}) == len(x & y) for a, x in zip(seeds, picks) for b, y in zip(seeds, picks))
    items = spark.createDataFrame([(1, texts[-2], texts[7])], "item_id long, question string, paragraph_text string")
    kept = LE.seed_hashes(h, at, LE.seed_bits(LE.test_texts(items))).to_pylist()
    wanted = {*seeds[-2], *seeds[7]}
    assert all({*s} & wanted <= {*k} <= {*s} for s, k in zip(seeds, kept)) and sum(map(len, kept)) < sum(map(len, seeds)) / 2


def test_leaks_build_no_array_by_lambda_and_chain_only_what_can_reach(spark, monkeypatch):
    rng = random.Random(13)
    text = [rng.choice(WORDS) for _ in range(50)]
    items = spark.createDataFrame([(1, " ".join(text[:20]), " ".join(text))], "item_id long, question string, paragraph_text string")
    docs = spark.createDataFrame([(1, " ".join(text[:30]))], "doc_id long, text string")
    assert "lambda" not in LE.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    a, b = np.arange(40, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)
    monkeypatch.setattr(LE, "_PAIR_WORDS", 300)
    assert LE.chains([a, b, a, a[:0], a, b], [b, b, a, a, a[:0], b], [20, 0, 41, 0, 0, 101]) == [20, 100, None, 0, 0, None] and LE.chained_words(a, b) == 20


def test_short_items_and_common_seeds(spark):
    rng = random.Random(9)
    shared = " ".join(rng.choice(WORDS) for _ in range(40))
    items = [(i, f"{shared} tail{i}", None) for i in range(6)] + [(10, "Who may sign?", "w1x w2x w3x w4x w5x"), (11, "", "one")]
    docs = [(1, f"see {shared}"), (2, f"see {shared} tail3."), (3, "x who may, sign it"), (4, "w2x w3x and"), (5, "who sign may")]
    got = {tuple(r) for r in LE.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, paragraph_text string")).collect()}
    assert got == {(1, i) for i in range(6)} | {(2, i) for i in range(6)} | {(3, 10), (4, 10)}


PROSE = "The board shall review the annual report and publish it after the audit in the central ledger. "


def test_forms(spark):
    rng = random.Random(1)
    nouns = ["ledger", "branch", "deposit", "credit", "report", "loan", "audit", "letter", "tariff", "buffer", "record", "ticket"]
    prose = [(i, " ".join(rng.sample((PROSE * 3).split(), 30)) + ".\n" + PROSE) for i in range(60)]
    lists = [(100 + i, "\n".join(f"- {a} {b}" for a, b in zip(rng.sample(nouns, 8), rng.sample(nouns, 8)))) for i in range(5)]
    tables = [(200 + i, "\n".join(f"{rng.choice(nouns)}\t{rng.randint(1, 999)}\t{rng.random():.2f}" for _ in range(8))) for i in range(5)]
    junk = [(300, "".join(rng.choice("qxzvkj ") for _ in range(400))), (301, "Home | Menu | Login | " * 30), (302, "deposit\n" * 40)]
    mixed = [(400, PROSE * 4 + "\n- ledger\n- branch")]
    df = spark.createDataFrame([(*r, "x") for r in prose + lists + tables + junk + mixed] + [(500, None, "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.form for r in QU.not_prose(df.where("doc_id < 500")).collect()}
    assert {k: v for k, v in got.items() if k >= 100} == {**{100 + i: "list" for i in range(5)}, **{200 + i: "table" for i in range(5)}, 300: "junk", 301: "junk", 302: "junk"}
    assert not [k for k in got if k < 100]
    s = QU.scored(df).where("doc_id = 301").first()
    assert sum(s[f"c_{x}"] for x in QU.STATS) == pytest.approx(s.distance2)


FRENCH = "Le conseil doit examiner le rapport annuel et le publier après la vérification dans le registre central. "


def test_distance_decides_per_language(spark):
    rng = random.Random(3)
    prose = [(i, " ".join(rng.sample((PROSE * 3).split(), 30)) + ".\n" + PROSE, None) for i in range(60)] + [(100 + i, " ".join(rng.sample((FRENCH * 3).split(), 30)) + ".\n" + FRENCH, "x") for i in range(30)]
    odd = [(500, " ".join(w + "#~%" for w in (PROSE * 4).split()), None), (501, "ledger;12;3.5;x\n" * 3 + "branch;7;1.5;y", None)]
    df = spark.createDataFrame(prose + odd, "doc_id long, text string, language string")
    got = {r.doc_id: r for r in QU.scored(df).collect()}
    assert {k for k, r in got.items() if r.form} == {500, 501} == {k for k, r in got.items() if r.distance2 > QU.CUT}
    assert got[500].plain_share >= 0.5 and got[500].c_symbol_ratio > got[500].distance2 / 2 and got[501].form == "table"
    assert {r.language for k, r in got.items() if 100 <= k < 500} == {"fr"} and got[0].language == "en"


def test_tables_may_be_most_documents(spark):
    rng = random.Random(2)
    prose = [(i, " ".join(rng.sample((PROSE * 3).split(), 30)) + ".\n" + PROSE) for i in range(40)]
    tables = [(100 + i, "\n".join(f"{rng.choice(WORDS)}\t{rng.randint(1, 999)}\t{rng.random():.2f}" for _ in range(8))) for i in range(50)]
    arabic = [(200 + i, "\n".join(f"{rng.choice(['دفتر', 'فرع', 'تقرير'])}\t{rng.randint(1, 999)}\t{rng.randint(1, 99)}" for _ in range(8))) for i in range(20)]
    got = {r.doc_id: r.form for r in QU.not_prose(spark.createDataFrame(prose + tables + arabic, "doc_id long, text string")).collect()}
    assert got == {i: "table" for i, _ in tables + arabic}
    only = QU.not_prose(spark.createDataFrame(arabic, "doc_id long, text string"))
    assert only.count() == len(arabic)


def test_confusions():
    assert SC.confused("decision", "decislon") == ["i:l"] and SC.confused("settlement", "settlernent") == ["m:rn"] and SC.confused("cat", "dog") is None and SC.confused("cat", "cat") == []
    assert SC._fold("decislon") == SC._fold("decision") and SC._fold("circiilates") == SC._fold("circulates")


def test_scan_noise_and_repair(spark):
    base = "the committee shall review every decision and publish the annual report before the audit begins"
    rows = [("doc", 1, "paragraph", f"doc-{i:04d}", base, "n") for i in range(40)]
    rows += [
        ("doc", 2, "paragraph", "doc-1001", "Annual Report Circular 7\nthe committee shall review every decislon and pub-\nlish the annual report before the audit begins\n2", "n"),
        ("doc", 3, "paragraph", "doc-1002", "3   Annual Report Circular 7\nthe committee shall review every decision", "n"),
        ("doc", 4, "paragraph", "doc-1003", "the committee shall review\n17\nevery decision", "n"),
        ("doc", 5, "heading", "doc-1004", "pub-\nlish", "n"), ("doc", 5, "paragraph", "doc-1005", None, "n"), ("doc", None, "paragraph", "doc-1006", "the com­\nmittee\n- 9 -", "n"),
    ]
    df = spark.createDataFrame(rows + rows[40:42], "docName string, page int, elementType string, elementId string, text string, noise string")
    got = {tuple(r) for r in SC.noise(df).collect()}
    assert got == {("doc-1001", "line_break"), ("doc-1001", "misread"), ("doc-1001", "running_header"), ("doc-1001", "page_number"), ("doc-1002", "running_header"), ("doc-1006", "line_break"), ("doc-1006", "page_number")}
    fixed = {r.elementId: r.text for r in SC.repaired(df).collect()}
    assert fixed["doc-1001"] == base and fixed["doc-1006"] == "the committee"


SCANNED = "docName string, page int, elementType string, elementId string, text string"


def test_one_form_is_read_by_its_place(spark):
    rows = [("d", 1, "paragraph", f"d-{i:04d}", "the fresh bait hangs on a hook while some silver balt coins lie in a chest") for i in range(60)]
    rows += [("d", 2, "paragraph", "d-1000", "the fresh ba1t hangs on a hook while some silver ba1t coins lie in a chest"), ("d", 3, "paragraph", "d-1001", "- 3 -"), ("d", 3, "paragraph", "d-1002", "4")]
    rows += [("d", 4, "paragraph", f"d-2{i:03d}", "a plain bart stays in this house") for i in range(5)]
    df = spark.createDataFrame(rows, SCANNED)
    assert {tuple(r) for r in SC.noise(df).collect()} == {("d-1000", "misread"), ("d-1001", "page_number")}
    fixed = {r.elementId: r.text for r in SC.repaired(df).collect()}
    assert fixed["d-1000"] == rows[0][4] and fixed["d-2000"] == rows[-1][4] and fixed["d-1001"] == "" and fixed["d-1002"] == "4"


def test_a_rare_word_in_its_own_context_stays():
    pair = {("of", "tor"): 6, ("of", "for"): 0, ("a", "for"): 900, ("a", "tor"): 3}
    single = {"of": 50, "a": 4000, "for": 1000, "tor": 10}
    options = {"tor": [("for", -4.6, 0.01)]}
    assert SC.viterbi(["of", "tor"], options, pair, single, 10000) == ["of", "tor"]
    assert SC.viterbi(["a", "tor"], options, pair, single, 10000) == ["a", "for"]


def test_chunks_are_repaired_with_the_elements(spark):
    base = "the committee shall review every decision and publish the annual report before the audit begins"
    rows = [("d", 1, "paragraph", f"d-{i:04d}", base) for i in range(40)] + [("d", 2, "paragraph", f"d-{i}", f"Annual Report Circular 7\n{base}") for i in (100, 101)]
    chunks = [("c1", "d", [2], f"Annual Report Circular 7\nthe committee shall review every decislon and\npub-\nlish the annual report\n2\n\n- one\n- two\n\n| a | b |\n| c | d |", 0), ("c2", "d", None, None, 1), (None, "d", [1], "x", 2), ("c3", None, None, "", 3)]
    got = {r.chunkId: r.text for r in SC.repaired_chunks(spark.createDataFrame(rows, SCANNED), spark.createDataFrame(chunks, "chunkId string, docName string, pages array<int>, text string, line int")).collect()}
    assert got == {"c1": "the committee shall review every decision and publish the annual report\n\n- one\n- two\n\n| a | b |\n| c | d |", "c3": ""}


def test_document_statistics_nulls(spark):
    s = QU.document_statistics(spark.createDataFrame([(1, None), (2, "Word.\n\nTwo words!")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.lines, r.words) for r in s] == [(2, 2, 3)]
