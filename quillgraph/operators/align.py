"""Alignment of duplicate entities and the merge of their graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import vector as V
from quillgraph.operators.components import connected_components


def duplicate_links(entities: DataFrame, least: float = 0.92, skip: tuple[str, ...] = (), parts: int = 4) -> DataFrame:
    """``a, b``: entities of one type with the same normalised name, or (but for ``skip`` types) with a cosine of ``least`` or more.

    Equal names are linked to the smallest id of their group: a star instead of
    all pairs, with the same components.
    """
    e = entities.withColumn("norm", X.normalize_arabic(F.col("name")))
    low = e.groupBy("type", "norm").agg(F.min("id").alias("b"))
    same = e.join(low, ["type", "norm"]).where("id != b").select(F.col("id").alias("a"), "b")
    near = V.similar_pairs(e.where(~F.col("type").isin(list(skip))), least, "type", parts).select("a", "b")
    return same.unionByName(near)


def clusters(links: DataFrame) -> DataFrame:
    """``id, cluster`` of entities with at least one duplicate."""
    c = connected_components(links, "a", "b")
    return c.select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def canonical_map(members: DataFrame, entities: DataFrame) -> DataFrame:
    """``id, canonical``: in each cluster the entity with the most mentions, then the longest name, then the smallest id."""
    m = members.join(entities.select("id", "name", "mentions"), "id")
    best = m.groupBy("cluster").agg(F.min(F.struct((-F.col("mentions")).alias("m"), (-F.length("name")).alias("l"), "id")).alias("b"))
    return m.join(best, "cluster").select("id", F.col("b.id").alias("canonical"))


def merged(entities: DataFrame, mentions: DataFrame, edges: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Entities, mentions and edges after duplicates gave way to their canonical entity.

    Edges of every type are redirected on both ends, loops that arise go, and
    parallel edges add their weights and join their ``chunkIds`` (where the
    table has them). A canonical entity keeps its own ``aliases`` first,
    followed by the names and aliases of its duplicates in order; its own name
    is no alias. Other columns stay as they are.
    """
    m = mapping.select("id", "canonical")
    to = lambda df, c: df.join(m.select(F.col("id").alias(c), F.col("canonical").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    sums = [F.sum("weight").alias("weight")]
    if "chunkIds" in edges.columns:
        sums.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunkIds")))).alias("chunkIds"))
    e = to(to(edges.where("src != dst"), "src"), "dst").where("src != dst").groupBy("src", "type", "dst").agg(*sums)
    none = F.array().cast("array<string>")
    known = F.coalesce("aliases", none) if "aliases" in entities.columns else none
    gone = entities.join(m, "id").where("id != canonical").select("canonical", F.concat(F.array("name"), known).alias("n"))
    names = gone.groupBy(F.col("canonical").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))).alias("_more"))
    kept = entities.withColumn("aliases", known).join(m.where("id != canonical").select("id"), "id", "left_anti").join(names, "id", "left")
    aliases = F.array_remove(F.array_distinct(F.concat("aliases", F.coalesce("_more", none))), F.col("name"))
    return {
        "entities": kept.withColumn("aliases", F.coalesce(aliases, none)).drop("_more"),
        "mentions": to(mentions.withColumnRenamed("entity", "id"), "id").select("chunk", F.col("id").alias("entity")).distinct(), "edges": e,
    }
