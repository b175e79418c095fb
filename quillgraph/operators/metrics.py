"""Evaluation metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.runtime import cut


def ratio(a, b):
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def span_prf(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 of distinct span keys."""
    k = [*by, *keys]
    g = gold.select(*k).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*k).distinct().withColumn("p", F.lit(1))
    c = g.join(p, k, "full").groupBy(*by).agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": pr, "recall": rc}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranking_metrics(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query recall@k, precision@k (over k) and reciprocal rank; null without gold.

    ``retrieved`` has ``query, item, rank`` (from 1), ``gold`` ``query, item``.
    """
    g = gold.select("query", "item").distinct()
    n = g.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    hit = retrieved.join(g.withColumn("hit", F.lit(1)), ["query", "item"], "left").groupBy("query").agg(F.count_if((F.col("hit") == 1) & (F.col("rank") <= k)).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    j = hit.join(n, "query", "left")
    none = F.col("relevant").isNull()
    return j.select("query", F.when(~none, F.col("found") / F.col("relevant")).alias("recall"), F.when(~none, F.col("found") / F.lit(k)).alias("precision"), F.when(~none, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def recall_hits(retrieved: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 2, 5, 10), by: str = "hop") -> DataFrame:
    """Mean recall@K and hit@K per group and over all (group null), by rollup; a query without gold counts 0."""
    g = gold.select("query", "item").distinct()
    n = g.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    q = retrieved.select("query", by).distinct()
    hit = retrieved.join(g, ["query", "item"], "left_semi").groupBy("query").agg(*[F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in ks])
    per = q.join(n, "query", "left").join(hit, "query", "left")
    f = lambda k: F.coalesce(F.col(f"f{k}"), F.lit(0))
    per = per.select(by, *[ratio(f(k), F.col("relevant")).alias(f"r{k}") for k in ks], *[(f(k) > 0).cast("double").alias(f"h{k}") for k in ks])
    return per.rollup(by).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(f"r{k}").alias(f"recall_{k}") for k in ks], *[F.avg(f"h{k}").alias(f"hit_{k}") for k in ks])


def agreement(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row with NMI, ARI and entropies of two labelings of the same items; 1 where both are constant."""
    t = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    tot = t.agg(F.sum("n").alias("total"))
    ra = t.groupBy("a").agg(F.sum("n").alias("na"))
    rb = t.groupBy("b").agg(F.sum("n").alias("nb"))
    comb = lambda c: c * (c - 1) / 2
    ha = ra.crossJoin(tot).agg(F.sum(-F.col("na") / F.col("total") * F.log(F.col("na") / F.col("total"))).alias("ha"), F.sum(comb(F.col("na"))).alias("ca"))
    hb = rb.crossJoin(tot).agg(F.sum(-F.col("nb") / F.col("total") * F.log(F.col("nb") / F.col("total"))).alias("hb"), F.sum(comb(F.col("nb"))).alias("cb"))
    mi = t.join(ra, "a").join(rb, "b").crossJoin(tot).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(comb(F.col("n"))).alias("cab"), F.max("total").alias("total"))
    j = mi.crossJoin(ha).crossJoin(hb)
    expected = F.col("ca") * F.col("cb") / comb(F.col("total"))
    best = (F.col("ca") + F.col("cb")) / 2
    nmi = F.when(F.col("ha") + F.col("hb") == 0, F.lit(1.0)).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb")))
    return j.select(nmi.alias("nmi"), F.when(best == expected, F.lit(1.0)).otherwise((F.col("cab") - expected) / (best - expected)).alias("ari"), "ha", "hb")


def modularity(adj: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: sum over communities of inside/2m - gamma (total/2m)^2; ``adj`` holds both directions."""
    l = labels.select("node", "label")
    e = adj.join(l.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(l.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    c = e.groupBy(F.col("ls").alias("label")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m2 = c.agg(F.sum("total").alias("m2"))
    return c.crossJoin(m2).agg(F.sum(F.col("inside") / F.col("m2") - gamma * F.pow(F.col("total") / F.col("m2"), 2)).alias("modularity"))


def percentiles(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """p50, p95, p99 (linear interpolation) and the maximum."""
    return df.groupBy(*by).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.max(value).alias("max"))


def rank_above(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank as the number of strictly greater values plus one; a null value has none.

    Over all rows, distinct values are counted, dealt over ranges and their
    counts prefix-summed, so no task sees every row.
    """
    if by:
        return df.withColumn("rank", F.when(F.col(value).isNotNull(), F.rank().over(W.Window.partitionBy(*by).orderBy(F.desc_nulls_last(value)))))
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(n.repartitionByRange(F.desc("_v")).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("all"))
    before = sums.select("part", F.coalesce(F.sum("all").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(W.Window.partitionBy("part").orderBy(F.desc("_v")).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("inside", inside).join(before, "part").select("_v", (F.col("before") + F.col("inside") + 1).alias("rank"))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def plurality_parent(children: DataFrame) -> DataFrame:
    """Most frequent ``parent`` per ``child`` over nodes; the smaller one on ties."""
    n = children.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("child").agg(F.min(F.struct((-F.col("n")).alias("k"), "parent", "n")).alias("m")).select("child", "m.parent", "m.n")


def stratified_sample(df: DataFrame, strata: str, key: str, n: int, groups: int, seed: int = 42) -> DataFrame:
    """max(1, n // groups) rows per stratum in hash order, ``n`` in all."""
    per = max(1, n // max(1, groups))
    h = F.xxhash64(F.lit(seed), F.col(key))
    w = W.Window.partitionBy(strata).orderBy(h, key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per).orderBy("rn", strata).limit(n).drop("rn")


def mean_spread(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def majority_share(labels: DataFrame, found: str = "found", true: str = "true") -> DataFrame:
    """One row: the share of items whose true label is the commonest of their found group."""
    n = labels.groupBy(found, true).agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(found).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return g.agg((F.sum("most") / F.sum("all")).alias("share"))


def train_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Column ``part``: train or test by the hash of the key, so that a row never changes sides when rows are added."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") % 10_000
    return df.withColumn("part", F.when(h < int(share * 10_000), "train").otherwise("test"))


def ingest_counts(elements: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per document: elements, chunks and distinct mentioned entities; 0 where a stage has none."""
    e = elements.groupBy("docName").agg(F.count_distinct("elementId").alias("elements"))
    c = chunks.groupBy("docName").agg(F.count_distinct("chunkId").alias("chunks"))
    m = mentions.groupBy("docName").agg(F.count_distinct("text").alias("entities"))
    return e.join(c, "docName", "full").join(m, "docName", "full").na.fill(0, ["elements", "chunks", "entities"])


def token_accuracy(tokens: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    """One row: the share of tokens whose found label is the true one, null labels counting as wrong."""
    return tokens.agg(F.count(F.lit(1)).alias("tokens"), F.avg(F.coalesce(F.col(gold) == F.col(found), F.lit(False)).cast("double")).alias("accuracy"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    """``label, n, share`` of every label, null included."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("label", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def value_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of rows, least, most, mean and total of a value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
