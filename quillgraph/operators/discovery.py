"""Relational parts of corpus-wide search and of the search for unknown entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def report_members(adj: DataFrame, labels: DataFrame, words: DataFrame, budget: int) -> DataFrame:
    """``label, node, rank``: the members of each community by degree, as many as fit the budget of ``words`` (``node, words``).

    What a report on a community is written from; the writing is a model hook.
    """
    deg = adj.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
    j = labels.select("node", "label").join(deg, "node", "left").join(words, "node")
    w = W.Window.partitionBy("label").orderBy(F.desc_nulls_last("degree"), "node")
    r = j.withColumns({"rank": F.row_number().over(w), "used": F.sum("words").over(w.rowsBetween(W.Window.unboundedPreceding, 0))})
    return r.where(F.col("used") <= budget).select("label", "node", "rank")


def batches(reports: DataFrame, budget: int, seed: int = 1) -> DataFrame:
    """Reports ``report, words`` dealt in hash order into batches of about ``budget`` words for the map step of a corpus-wide question."""
    total = reports.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all"))
    return reports.crossJoin(total).select("report", "words", F.pmod(F.xxhash64(F.lit(seed), "report"), F.greatest(F.lit(1), F.ceil(F.col("all") / budget)).cast("bigint")).alias("batch"))


def unknown_phrases(phrases: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """``phrase, n, chunkIds``: phrases (``chunkId, phrase``) of no known span, in at least ``least`` places."""
    new = phrases.join(known.select("chunkId", F.col("text").alias("phrase")).distinct(), ["chunkId", "phrase"], "left_anti")
    return new.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("chunkId")).alias("chunkIds")).where(F.col("n") >= least)


def phrase_clusters(vectors: DataFrame, k: int = 15, top: int = 20, seed: int = 1) -> DataFrame:
    """``cluster, id, rank``: k-means over ``id, vector``, the ``top`` members nearest to each centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.where("vector is not null").withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(v)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    p = model.transform(v).select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("f")).join(F.broadcast(centres), "cluster")  # k rows
    d = F.aggregate(F.zip_with("f", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    r = p.withColumn("d", d).withColumn("rank", F.row_number().over(W.Window.partitionBy("cluster").orderBy("d", "id")))
    return r.where(F.col("rank") <= top).select("cluster", "id", "rank")
