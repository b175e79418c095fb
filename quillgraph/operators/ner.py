"""Tokens, BIO labels and span evaluation for entity recognition."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quillgraph.functions import text as X

# Fixed value: what counts as one token.
_TOKEN = re.compile(r"[\d٠-٩]+(?:-[\d٠-٩]+)+|[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿a-zA-Z0-9]+|\S")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def exact_tokens(text: pd.Series) -> pd.Series:
    """Clause references, runs of letters and digits, and single other characters, with their character offsets."""
    return text.map(lambda t: [{"word": m.group(), "start": m.start(), "end": m.end()} for m in _TOKEN.finditer(t or "")])


def word_offsets(df: DataFrame, key: str, words: str) -> DataFrame:
    """``key, i, word, start, end`` of words joined by single blanks: offsets are a running sum, one row wide."""
    starts = F.expr(f"aggregate({words}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, w) -> named_struct('at', a.at + length(w) + 1, 'out', array_append(a.out, a.at)), a -> a.out)")
    z = df.select(key, F.col(words).alias("w"), starts.alias("s")).select(key, F.posexplode(F.arrays_zip("w", "s")).alias("i", "z"))
    return z.select(key, "i", F.col("z.w").alias("word"), F.col("z.s").alias("start"), (F.col("z.s") + F.length("z.w")).alias("end"))


def bio_labels(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Tokens with a label: B for the first token inside a span, I for later ones, O outside; a later span (by start, end) overwrites.

    ``tokens`` has ``key, i, start, end`` and ``spans`` ``key, start, end``.
    """
    s = spans.select(F.col(key), F.col("start").alias("ss"), F.col("end").alias("se")).distinct()
    j = tokens.join(s, key).where("start >= ss and end <= se")
    first = F.row_number().over(W.Window.partitionBy(key, "ss", "se").orderBy("i"))
    last = j.withColumn("rn", first).groupBy(key, "i").agg(F.max(F.struct("ss", "se", "rn")).alias("m"))
    lab = last.select(key, "i", F.when(F.col("m.rn") == 1, "B").otherwise("I").alias("label"))
    return tokens.join(lab, [key, "i"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def bio_spans(labelled: DataFrame, key: str) -> DataFrame:
    """Spans of BIO labels: B opens, I goes on, O closes, I without an open span is passed over."""
    w = W.Window.partitionBy(key).orderBy("i")
    brk = F.sum(F.when(F.col("label") == "I", 0).otherwise(1)).over(w)
    g = labelled.withColumn("g", brk)
    head = F.first("label").over(W.Window.partitionBy(key, "g").orderBy("i"))
    kept = g.withColumn("head", head).where("head = 'B' and label != 'O'")
    return kept.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text")).drop("g")


def without_triggers(spans: DataFrame, triggers: Sequence[str]) -> DataFrame:
    return spans.where(~F.col("text").isin(list(triggers)))


def task_spans(tasks: DataFrame) -> DataFrame:
    """``chunkId, docName, id, text, type, start, end`` of annotation tasks: every result of kind ``labels`` with its first label."""
    r = tasks.select("meta.chunkId", "meta.docName", F.explode("predictions").alias("p")).select("chunkId", "docName", "p.model_version", F.explode("p.result").alias("r"))
    return r.where("r.type = 'labels'").select("chunkId", "docName", "model_version", "r.id", F.col("r.value.text").alias("text"), F.get("r.value.labels", F.lit(0)).alias("type"), F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end")).distinct()


def as_tasks(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans and their texts back as nested annotation tasks; spans of unknown texts drop out."""
    res = spans.select("chunkId", F.struct("id", F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), F.struct("start", "end", "text", F.array("type").alias("labels")).alias("value")).alias("r"))
    g = res.groupBy("chunkId").agg(F.array_sort(F.collect_list("r")).alias("result"))
    return texts.join(g, "chunkId").select(F.struct("text").alias("data"), F.struct("chunkId", "docName").alias("meta"), F.array(F.struct(F.lit(None).cast("string").alias("model_version"), "result")).alias("predictions"))


def gazetteer(spans: DataFrame, least: float = 0.75) -> DataFrame:
    """Per type the sorted first surfaces of normalised texts scored ``least`` or more."""
    g = spans.where(F.col("score") >= least).withColumn("norm", X.normalize_arabic(F.col("text"))).groupBy("type", "norm").agg(F.min_by("text", "seq").alias("surface"))
    return g.groupBy("type").agg(F.sort_array(F.collect_set("surface")).alias("surfaces"))


def sentence_islands(lines: DataFrame) -> DataFrame:
    """CoNLL lines ``n, value`` with sentence numbers: a blank line ends a sentence; the first and last field are word and label.

    Blank lines are counted per range of lines and prefix-summed over ranges,
    so a file of any length is numbered without one task reading it all.
    """
    l = lines.withColumn("blank", (F.trim("value") == "").cast("int")).withColumn("part", F.floor(F.col("n") / 100_000))
    before = l.groupBy("part").agg(F.sum("blank").alias("b")).withColumn("before", F.coalesce(F.sum("b").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    at = F.sum("blank").over(W.Window.partitionBy("part").orderBy("n"))
    s = l.withColumn("s", at).join(before, "part").withColumn("sentence", F.col("s") + F.col("before"))
    return s.where("blank = 0").select("sentence", "n", F.substring_index(F.trim("value"), " ", 1).alias("word"), F.substring_index(F.trim("value"), " ", -1).alias("label"))


def grouped_by_n(df: DataFrame, order: str, n: int, by: str) -> DataFrame:
    """Consecutive rows of a partition in groups of ``n``."""
    return df.withColumn("group", F.floor((F.row_number().over(W.Window.partitionBy(by).orderBy(order)) - 1) / n))


def flags(word: Column, org: Sequence[str], money: Sequence[str], months: Sequence[str]) -> dict[str, Column]:
    return {"is_org_trigger": word.isin(list(org)), "in_money_trigger": word.isin(list(money)), "in_month": word.isin(list(months))}


# Fixed value: the same tokens without single characters of other kinds told apart, as a pattern of the JVM.
WORD_PATTERN = "([0-9٠-٩]+-[0-9٠-٩]+(?:-[0-9٠-٩]+)*|[؀-ۿa-zA-Z0-9]+|[^\\s])"


def token_windows(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys, i, w_2, w_1, w, w1, w2``: each token with two on either side, ``__START__`` and ``__END__`` beyond the ends.

    A text's tokens are one array, so neighbours are looked up in place without a shuffle.
    """
    t = df.select(*keys, F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(1)).alias("_t")).where(F.size("_t") > 0)
    p = F.concat(F.array(F.lit("__START__"), F.lit("__START__")), "_t", F.array(F.lit("__END__"), F.lit("__END__")))
    five = F.expr("transform(sequence(1, size(_p) - 4), i -> named_struct('w_2', _p[i - 1], 'w_1', _p[i], 'w', _p[i + 1], 'w1', _p[i + 2], 'w2', _p[i + 3]))")
    return t.withColumn("_p", p).select(*keys, F.posexplode(five).alias("i", "_x")).select(*keys, "i", "_x.*")
