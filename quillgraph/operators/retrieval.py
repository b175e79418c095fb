"""Retrieval: rank fusion, path scores, k-hop and graph search, and the clearance-scoped dispatcher."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.operators import graph as G
from quillgraph.operators import ppr as P
from quillgraph.operators import vector as V

# Access levels from open to closed, and the one of documents that name none.
LEVELS = ("public", "internal", "confidential", "restricted")
DEFAULT_LEVEL = "internal"
#: Constant of reciprocal rank fusion.
RRF_K = 60


def level_rank(level: Column) -> Column:
    """1 for the most open level; unknown, null and differently written levels are read leniently."""
    norm = F.lower(F.trim(F.coalesce(level, F.lit(DEFAULT_LEVEL))))
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), norm)
    return F.when(at > 0, at).otherwise(F.lit(LEVELS.index(DEFAULT_LEVEL) + 1)).cast("int")


def visible(df: DataFrame, clearance: str, level: str = "accessLevel") -> DataFrame:
    """Rows whose level the clearance covers."""
    if clearance not in LEVELS:
        return df.limit(0)
    return df.where(level_rank(F.col(level)) <= LEVELS.index(clearance) + 1)


def rrf(lists: Sequence[DataFrame], top: int | None = None) -> DataFrame:
    """Fuses ranked lists ``id, rank`` (0-based): score is the sum of 1/(60+rank+1); ties go to the list and place seen first."""
    out = None
    for n, df in enumerate(lists):
        part = df.select("id", F.col("rank").cast("int").alias("rank"), F.lit(n).alias("list"))
        out = part if out is None else out.unionByName(part)
    g = out.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    g = g.orderBy(F.desc("score"), "first") if top is None else g.orderBy(F.desc("score"), "first").limit(top)
    return g.select("id", "score")


def ranked(df: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """0-based places of a short list (the output of a top-k)."""
    return df.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc(score), key)) - 1)


def path_scores(paths: DataFrame, entity_scores: DataFrame, relation_scores: DataFrame | None = None, entity_weight: float = 0.6) -> DataFrame:
    """Mean entity cosine, or its mix with the mean relation cosine.

    ``paths`` has ``path_id, nodes`` and, with relations, ``relations``;
    entities and relations without a score are skipped, a path without any
    scores 0.
    """
    e = paths.select("path_id", F.explode("nodes").alias("id")).join(entity_scores.select("id", "score"), "id").groupBy("path_id").agg(F.avg("score").alias("e"))
    out = paths.join(e, "path_id", "left")
    if relation_scores is None:
        return out.withColumn("score", F.coalesce("e", F.lit(0.0))).drop("e")
    r = paths.select("path_id", F.explode("relations").alias("id")).join(relation_scores.select("id", "score"), "id").groupBy("path_id").agg(F.avg("score").alias("r"))
    both = entity_weight * F.coalesce("e", F.lit(0.0)) + (1 - entity_weight) * F.coalesce("r", F.lit(0.0))
    return out.join(r, "path_id", "left").withColumn("score", F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(both)).drop("e", "r")


def chunk_max(paths: DataFrame, chunks_of: DataFrame, best: int = 3) -> DataFrame:
    """Chunk score = best path through it, only above 0, with the ``best`` paths.

    ``chunks_of`` maps ``path_id`` to ``chunk``.
    """
    hit = paths.where("score > 0").join(chunks_of.distinct(), "path_id")
    rn = F.row_number().over(W.Window.partitionBy("chunk").orderBy(F.desc("score"), "path_id"))
    return hit.withColumn("rn", rn).groupBy("chunk").agg(F.max("score").alias("score"), F.expr(f"transform(array_sort(collect_list(struct(rn, path_id)) filter (where rn <= {best})), x -> x.path_id)").alias("paths"))


def chunks_of_paths(paths: DataFrame, mentions: DataFrame, best: int = 3) -> DataFrame:
    """Chunk score = best path through any of its entities: ``paths`` has ``path_id, nodes, score``.

    Each entity first keeps its own ``best`` paths; those of a chunk are among
    its entities' ones, so the many paths never meet the mentions.
    """
    e = paths.where("score > 0").select("path_id", "score", F.explode(F.array_distinct("nodes")).alias("entity"))
    rn = F.row_number().over(W.Window.partitionBy("entity").orderBy(F.desc("score"), "path_id"))
    few = e.withColumn("rn", rn).where(F.col("rn") <= best).drop("rn")
    hit = few.join(mentions.select("entity", "chunk").distinct(), "entity").select("chunk", "path_id", "score").distinct()
    rn = F.row_number().over(W.Window.partitionBy("chunk").orderBy(F.desc("score"), "path_id"))
    return hit.withColumn("rn", rn).groupBy("chunk").agg(F.max("score").alias("score"), F.expr(f"transform(array_sort(collect_list(struct(rn, path_id)) filter (where rn <= {best})), x -> x.path_id)").alias("paths"))


def khop_chunks(edges: DataFrame, mentions: DataFrame, entities: DataFrame, query: DataFrame, seeds: int = 8, depth: int = 2, top: int = 10) -> DataFrame:
    """k-hop retrieval: seed entities by cosine, trails from them, a path's mean entity cosine, best path per chunk of its entities."""
    scores = V.scored(entities, query).select("id", "score")
    start = scores.orderBy(F.desc("score"), "id").limit(seeds).select(F.col("id").alias("node"))
    p = G.trail_paths(edges, start, depth).withColumn("path_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"))
    p = path_scores(p.select("path_id", "nodes").distinct(), scores)
    return chunks_of_paths(p, mentions).orderBy(F.desc("score"), "chunk").limit(top)


def seed_entities(entities: DataFrame, query: DataFrame, mentions: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` entities nearest to the query among those that an allowed chunk mentions."""
    seen = mentions.join(chunks.select("chunk").distinct(), "chunk", "left_semi").select(F.col("entity").alias("id")).distinct()
    return V.scored(entities.join(seen, "id", "left_semi"), query).orderBy(F.desc("score"), "id").limit(k)


def graph_search(edges: DataFrame, relations: DataFrame, entities: DataFrame, mentions: DataFrame, chunks: DataFrame, query: DataFrame, seeds: int = 8, depth: int = 3, k: int = 5) -> DataFrame:
    """``chunk, score, paths``: graph retrieval over typed edges.

    ``edges`` has ``edge_id, src, dst, type, chunkIds``. The relation types
    nearest to the query prune the edges before any expansion; trails from the
    allowed seeds score the mix of mean entity and mean relation cosine; a
    chunk on a path's edges gets its best path. ``chunks`` are the allowed
    ones (``chunk``).
    """
    types = V.relation_selection(relations, query).select(F.col("id").alias("type"))
    pruned = edges.join(types, "type", "left_semi")
    start = seed_entities(entities, query, mentions, chunks, seeds).select(F.col("id").alias("node"))
    p = G.trail_paths(pruned, start, depth).withColumn("path_id", F.concat_ws(">", F.transform("nodes", lambda x: x.cast("string")), F.transform("edges", lambda x: x.cast("string"))))
    on = p.select("path_id", F.explode("edges").alias("edge_id")).join(pruned.select("edge_id", "type", "chunkIds"), "edge_id")
    kinds = on.groupBy("path_id").agg(F.collect_list("type").alias("relations"))
    scored = path_scores(p.select("path_id", "nodes").join(kinds, "path_id"), V.scored(entities, query), V.scored(relations, query))
    through = on.select("path_id", F.explode("chunkIds").alias("chunk")).distinct().join(chunks.select("chunk").distinct(), "chunk", "left_semi")
    return chunk_max(scored, through).orderBy(F.desc("score"), "chunk").limit(k)


def ppr_retrieve(adj: DataFrame, mentions: DataFrame, entities: DataFrame, texts: DataFrame, query: DataFrame, k: int = 10, seeds: int = 5, alpha: float = 0.5, iterations: int = 100, tolerance: float | None = 1e-9, specificity: bool = True, eps: float = 1e-6) -> DataFrame:
    """``chunk, score, contributors, text``: the whole retriever. The query's nearest entities are the seeds, by specificity if wanted; PageRank; entity scores summed by chunk; texts looked up.

    A query whose seeds lie outside the graph gives no hits.
    """
    nodes = adj.select(F.col("src").alias("node")).distinct()
    s = V.seed_masses(entities, query, seeds).select(F.col("id").alias("node"), "mass")
    s = P.seed_vector(s, nodes)
    if specificity:
        s = P.node_specificity(s, mentions)
    scores = P.personalized_pagerank(adj, s, alpha, iterations, tolerance)
    top = P.chunk_scores(scores, mentions, eps).orderBy(F.desc("score"), "chunk").limit(k)
    return lookup(top, texts, "chunk")


def lookup(hits: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Hits with the other columns of ``texts``, the first row of a key that occurs twice; unknown keys keep nulls."""
    rest = [c for c in texts.columns if c != key]
    one = texts.join(hits.select(key).distinct(), key, "left_semi")
    return hits.join(one.groupBy(key).agg(F.min(F.struct(*rest)).alias("_t")).select(key, "_t.*"), key, "left")


def retrieve(mode: str, k: int, clearance: str, searches: dict[str, Callable[[int, str], DataFrame]], empty: DataFrame) -> DataFrame:
    """The dispatcher: an unknown mode or clearance gives no hits."""
    if mode not in searches or clearance not in LEVELS:
        return empty.limit(0)
    return searches[mode](k, clearance)
