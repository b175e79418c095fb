"""Figures of single lines against their plain definitions, and what the lines are scanned for."""

import re

from pyspark.sql import functions as F

from quillgraph.llm import languages as L
from quillgraph.llm import quality as QU

LINES = [
    "The board shall review 12 reports.", "Le conseil doit examiner le rapport annuel", "المادة ٣ من النظام، رقم 45؟", "İSTANBUL ΣΑΣ 𝟘½² 😀😀 a b", "a\tb|c; d;e   f    g",
    "done." + "\"')]»”" * 6, "done" + "”" * 20, "”" * 15 + ".", "end.\r", "end.)\u2028", "3,5,x9,y", "a,1,b", "x" * 40, "- 7) item", "مدير the of", "…", "\x0b\x0c7",
]


def test_figures_of_lines(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")
    known = L.hits(w, "en") + L.hits(w, "ar")
    common = F.greatest(known, *[F.when(known * 10 < F.size(w), L.hits(w, k)).otherwise(0) for k in L.LATIN])
    gaps = n(r"\t|\||;(?=\S)|\S {3,}(?=\S)") + F.when(F.col("text").rlike(r"^[^,]*(,[^,\s]*\d[^,\s]*){2,}$"), 2).otherwise(0)
    letters = F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x))
    right = df.select(
        "doc_id", F.size(w).alias("words"), F.length("text").alias("chars"), n("[0-9٠-٩]").alias("digits"), n(r"[^\p{L}\p{M}\p{N}\s]").alias("symbols"),
        letters.alias("letters"), common.alias("common"), (gaps >= 2).cast("int").alias("rows"), F.col("text").rlike(r"[.!?:؟۔…][\"')\]»”]*$").cast("int").alias("ended"), (n("[؀-ۿ]") * 2 > letters).alias("arabic"),
    )
    got = {r.doc_id: r for r in QU.document_statistics(df).collect()}
    assert len(got) == len(LINES)
    for r in right.collect():
        g, per = got[r.doc_id], max(r.words, 1)
        assert (g.words, g.mean_word_len, g.common_share, g.symbol_ratio, g.digit_ratio, g.line_end_share, g.rows, g.language == "ar") == (r.words, r.letters / per, r.common / per, r.symbols / r.chars, r.digits / r.chars, r.ended, r.rows, r.arabic), LINES[r.doc_id]


def test_matches_are_not_listed_to_be_counted(spark):
    plan = QU.document_statistics(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    # the words, and the gaps of lines that have any
    assert len(re.findall(r"regexp_extract_all\(", plan)) == 2
    # all words are looked through once, then only the function words among them
    assert len(re.findall(r"filter\(w#", plan)) == 1
