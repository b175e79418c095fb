"""Full-text ranking with BM25 over an inverted index held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, len``; partial counts before the shuffle."""
    t = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("t"))
    flat = t.select("key", F.size("t").alias("len"), F.explode_outer("t").alias("term")).where("term is not null")
    return flat.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, score`` of documents with at least one query term.

    Lengths and the number of documents come from all documents; only rows of
    query terms are exploded to postings.
    """
    q = sorted({w.lower() for w in query})
    t = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen"))
    tf = t.select("key", "len", F.explode_outer(F.filter("t", lambda w: w.isin(q))).alias("term")).where("term is not null").groupBy("key", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    return s.groupBy("key").agg(F.sum(part).alias("score"))
