"""Personalized PageRank over an adjacency table and its projection to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.runtime import cut


def row_normalised(adj: DataFrame) -> DataFrame:
    """``src, dst, p``: weights over the row's sum; rows without weight have no entries."""
    deg = adj.groupBy("src").agg(F.sum("weight").alias("degree"))
    return adj.join(deg, "src").where("degree > 0").select("src", "dst", (F.col("weight") / F.col("degree")).alias("p"))


def uniform_seed(nodes: DataFrame, node: str = "node") -> DataFrame:
    """Equal mass on distinct nodes."""
    n = nodes.select(F.col(node).alias("node")).where("node is not null").distinct()
    return n.crossJoin(n.agg(F.count(F.lit(1)).alias("k"))).select("node", (1.0 / F.col("k")).alias("mass"))


def seed_vector(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seed mass on nodes of the graph, renormalised; empty where nothing is left."""
    kept = seeds.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sum("mass").alias("mass"))
    total = kept.agg(F.sum("mass").alias("total"))
    return kept.crossJoin(total).where("total > 0").select("node", (F.col("mass") / F.col("total")).alias("mass"))


def node_specificity(seeds: DataFrame, mentions: DataFrame, entity: str = "entity", chunk: str = "chunk") -> DataFrame:
    """Mass over the number of chunks that mention the node, renormalised; nodes in no chunk lose theirs."""
    n = mentions.groupBy(F.col(entity).alias("node")).agg(F.count_distinct(chunk).alias("chunks"))
    m = seeds.join(n, "node").select("node", (F.col("mass") / F.col("chunks")).alias("mass"))
    return seed_vector(m, m)


def transition_table(adj: DataFrame) -> DataFrame:
    """The stored, row-normalised matrix, partitioned by source."""
    return cut(row_normalised(adj).repartition("src"))


def personalized_pagerank(adj: DataFrame, seeds: DataFrame, alpha: float = 0.5, iterations: int = 100, tolerance: float | None = 1e-9, checkpoint_every: int = 5, transitions: DataFrame | None = None) -> DataFrame:
    """``node, score`` after r <- (1 - alpha) M'r + alpha s from r = s.

    Stops when the L1 change falls below ``tolerance`` (``None``: always runs
    all iterations). The transition table is partitioned by source once and
    kept; an iteration joins it with the scores and sums by target, with
    partial sums before the shuffle. Lineage is cut every few rounds. A graph
    that is asked often keeps its ``transitions`` (:func:`transition_table`).
    """
    m = transition_table(adj) if transitions is None else transitions
    s = cut(seeds.select("node", "mass"))
    r = s.select("node", F.col("mass").alias("score"))
    for i in range(1, iterations + 1):
        walked = m.join(r, m["src"] == r["node"]).select(F.col("dst").alias("node"), ((1 - alpha) * F.col("p") * F.col("score")).alias("v"))
        nxt = walked.unionByName(s.select("node", (alpha * F.col("mass")).alias("v"))).groupBy("node").agg(F.sum("v").alias("score"))
        if tolerance is not None or i % checkpoint_every == 0:
            nxt = cut(nxt)
        if tolerance is not None:
            change = nxt.alias("a").join(r.alias("b"), "node", "full").agg(F.sum(F.abs(F.coalesce("a.score", F.lit(0.0)) - F.coalesce("b.score", F.lit(0.0))))).first()[0] or 0.0
            if change < tolerance:
                return nxt
        r = nxt
    return r


def chunk_scores(scores: DataFrame, mentions: DataFrame, eps: float = 1e-6, entity: str = "entity", chunk: str = "chunk", contributors: int = 3) -> DataFrame:
    """Chunk score = sum of its entities' scores above ``eps``; with the best contributors."""
    m = mentions.select(F.col(entity).alias("node"), F.col(chunk).alias("chunk")).distinct()
    hit = m.join(scores.where(F.col("score") > eps), "node")
    top = F.row_number().over(W.Window.partitionBy("chunk").orderBy(F.desc("score"), "node"))
    ranked = hit.withColumn("rn", top)
    return ranked.groupBy("chunk").agg(
        F.sum("score").alias("score"),
        F.expr(f"transform(array_sort(collect_list(struct(rn, node, score)) filter (where rn <= {contributors})), x -> struct(x.node as entity, x.score as score))").alias("contributors"),
    )
