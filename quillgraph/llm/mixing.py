"""Mixing sources to target weights (problem 9).

Every record gets a hash-random key. The keys of a source are cut into buckets
of equal range; sums per bucket and their prefix sums say in which bucket a
source's budget ends, and only that one bucket is sorted and summed record by
record. Records before the cut are taken once more than those behind it; whole
epochs before that repeat all of them. No step sorts or gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.llm.tokens import VOCABULARY, token_count
from quillgraph.runtime import cut

#: Records that a bucket holds on average.
BUCKET = 2000


def source_of(c: Column) -> Column:
    """Source names without letter case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """``key, source, tokens, h``: the random key comes from the record's key, so repeated runs agree."""
    return docs.select(key, source_of(F.col("source")).alias("source"), token_count(F.col(text), path).alias("tokens"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))


def budgets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source ``target_share, max_repeats, records, have, budget``.

    The mixture is as large as the scarcest source allows: no source can give
    more than ``max_repeats`` times its tokens. Sources with a share but no
    tokens cannot be met by any size; they get none and do not bound the rest.
    """
    t = targets.select(source_of(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0")
    # a source named twice has its greatest share
    t = t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    have = records.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("have"))
    b = t.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("have", F.lit(0)).alias("have"))
    size = b.where("have > 0").agg(F.min(F.col("max_repeats") * F.col("have") / F.col("target_share")).alias("size"))
    return b.crossJoin(size).withColumn("budget", F.when(F.col("have") > 0, F.floor(F.col("size") * F.col("target_share") + 1e-6)).otherwise(0).cast("bigint")).drop("size")


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture (``key, source, tokens, copies``) and its report per source.

    Records of no target source, or without one, are not used. A record counts
    as it stands in the table: rows that repeat a key are records of their own.
    The cut falls before the first record, in key order, that would exceed the
    budget, so a source misses its budget by less than one record.
    """
    rec = cut(counted(docs, key, text, path, seed))
    plan = cut(budgets(rec, targets))
    buckets = max(1, -(-(plan.agg(F.max("records")).first()[0] or 1) // BUCKET))
    b = rec.withColumn("b", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets).cast("bigint"))
    epochs = F.expr("case when have > 0 then least(max_repeats, budget div have) else 0 end").cast("int")
    rest = F.expr("case when have > 0 and epochs < max_repeats then budget - epochs * have else 0 end").cast("bigint")
    used = b.join(plan.withColumn("epochs", epochs).select("source", "epochs", rest.alias("rest")), "source")
    sums = used.groupBy("source", "b").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    upto = sums.withColumn("upto", F.sum("t").over(W.Window.partitionBy("source").orderBy("b").rowsBetween(W.Window.unboundedPreceding, 0)))
    at = upto.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("b"))).alias("cut"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"))
    placed = used.join(at, "source")
    inside = placed.where("b = cut").withColumn("run", F.col("before") + F.sum("tokens").over(W.Window.partitionBy("source").orderBy("h", key).rowsBetween(W.Window.unboundedPreceding, 0))).withColumn("more", (F.col("run") <= F.col("rest")).cast("int")).drop("run")
    outside = placed.where("cut is null or b != cut").withColumn("more", (F.col("cut").isNull() | (F.col("b") < F.col("cut"))).cast("int"))
    # with nothing left beyond whole epochs, empty records before the cut would still be repeated once more
    copies = F.col("epochs") + F.when(F.col("rest") > 0, F.col("more")).otherwise(0)
    mix = outside.unionByName(inside).withColumn("copies", copies.cast("int")).where("copies > 0").select(key, "source", "tokens", "copies")
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.sum("copies").alias("uses"), F.max("copies").alias("most_repeats"))
    total = got.agg(F.sum("reached").alias("total"))
    report = plan.join(got, "source", "left").crossJoin(total).select(
        "source", "target_share", "max_repeats", "records", "have", "budget", F.coalesce("reached", F.lit(0)).alias("reached_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("reached") / F.col("total"), F.lit(0.0)).alias("reached_share"),
    )
    return mix, report
