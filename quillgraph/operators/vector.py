"""Exact vector search, similarity joins and seeds over embedding tables ``id, vector, type``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.functions import text as X
from quillgraph.functions.vectors import cosine, dot, unit


def _query(q: DataFrame) -> DataFrame:
    """One query vector as a broadcast row: its size does not depend on the data."""
    return F.broadcast(q.select(F.col("vector").alias("_q")).limit(1))


def scored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine of every vector to the query's; null vectors drop out."""
    return vectors.where("vector is not null").crossJoin(_query(query)).withColumn("score", cosine(F.col("vector"), F.col("_q"))).drop("_q", "vector")


def vector_search(vectors: DataFrame, query: DataFrame, k: int, allowed: DataFrame | None = None, on: str = "type") -> DataFrame:
    """Top ``k`` by cosine among allowed rows, ties by id.

    The access filter is a semi-join before the ranking, so the result never
    falls short while enough allowed rows exist.
    """
    v = vectors if allowed is None else vectors.join(allowed.select(on).distinct(), on, "left_semi")
    return scored(v, query).orderBy(F.desc("score"), "id").limit(k)


def overfetch_search(vectors: DataFrame, query: DataFrame, k: int, allowed: DataFrame, on: str = "type", factor: int = 4) -> DataFrame:
    """The compatible order: a pool of ``k * factor`` is ranked first and filtered afterwards, which may leave fewer than ``k``."""
    pool = scored(vectors, query).orderBy(F.desc("score"), "id").limit(k * factor)
    return pool.join(allowed.select(on).distinct(), on, "left_semi").orderBy(F.desc("score"), "id").limit(k)


def relation_selection(types: DataFrame, query: DataFrame, least: float = 0.25, best: int = 5) -> DataFrame:
    """Types with a cosine of ``least`` or more, at most ``best``; the single best where none reaches it."""
    r = scored(types, query).withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("score"), "id")))
    return r.where(((F.col("score") >= least) & (F.col("rank") <= best)) | (F.col("rank") == 1)).select("id", "score", "rank")


def seed_masses(entities: DataFrame, query: DataFrame, top: int = 5) -> DataFrame:
    """Top entities by cosine, negatives set to 0, as masses that sum to 1; none where all are 0."""
    t = scored(entities, query).orderBy(F.desc("score"), "id").limit(top).withColumn("s", F.greatest("score", F.lit(0.0)))
    total = F.sum("s").over(W.Window.partitionBy())
    return t.withColumn("total", total).where("total > 0").select("id", (F.col("s") / F.col("total")).alias("mass"))


def _blocked(vectors: DataFrame, block: str, parts: int) -> DataFrame:
    """Unit vectors, dealt over ``parts`` cells of their block: a hot block spreads over cells."""
    return vectors.where("vector is not null").select("id", F.col(block).alias("block"), unit(F.col("vector")).alias("u"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("cell"))


def similar_pairs(vectors: DataFrame, least: float, block: str = "type", parts: int = 4) -> DataFrame:
    """All pairs ``a < b`` of one block with a cosine of ``least`` or more.

    Each block is a grid of ``parts x parts`` cells: a row meets only the cells
    of one strip, so no task ever holds a whole block; raise ``parts`` with the
    block's size.
    """
    v = _blocked(vectors, block, parts)
    left = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("block", F.col("cell").alias("i"), F.col("other").alias("j"), F.col("id").alias("a"), F.col("u").alias("ua"))
    right = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("block", F.col("other").alias("i"), F.col("cell").alias("j"), F.col("id").alias("b"), F.col("u").alias("ub"))
    return left.join(right, ["block", "i", "j"]).where("a < b").withColumn("score", dot(F.col("ua"), F.col("ub"))).where(F.col("score") >= least).select("block", "a", "b", "score")


def nearest(vectors: DataFrame, base: DataFrame) -> DataFrame:
    """For every vector the id of the nearest of ``base`` (the smaller id on ties), itself left out, and the cosine.

    ``base`` is met in the same grid as in ``similar_pairs``; the best per
    vector is kept inside each task before it is shuffled.
    """
    parts = 4
    v = vectors.where("vector is not null").select("id", unit(F.col("vector")).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell"))
    b = base.where("vector is not null").select(F.col("id").alias("near"), unit(F.col("vector")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("cell"))
    s = v.join(b, "cell").where("id != near").withColumn("score", dot(F.col("u"), F.col("v")))
    return s.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "near")).alias("m")).select("id", "m.near", (-F.col("m.s")).alias("score"))


def search_all(queries: DataFrame, base: DataFrame, k: int, parts: int = 8) -> DataFrame:
    """``query, id, score``: the top ``k`` of ``base`` for every query vector, itself left out, ties by id.

    Base vectors are dealt over ``parts`` cells and queries are sent to each;
    a cell keeps its own top ``k`` per query, and only those are ranked
    together. Exact, and no cell holds the whole base.
    """
    q = queries.where("vector is not null").select(F.col("id").alias("query"), unit(F.col("vector")).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell"))
    b = base.where("vector is not null").select("id", unit(F.col("vector")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("cell"))
    s = q.join(b, "cell").where("query != id").select("query", "cell", "id", dot(F.col("u"), F.col("v")).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    local = s.withColumn("rn", F.row_number().over(W.Window.partitionBy("query", "cell").orderBy(*order))).where(F.col("rn") <= k)
    return local.withColumn("rn", F.row_number().over(W.Window.partitionBy("query").orderBy(*order))).where(F.col("rn") <= k).drop("rn", "cell")


def synonyms(entities: DataFrame, least: float = 0.85, parts: int = 4) -> DataFrame:
    """``src, dst, weight``: entities of one type, near by cosine, the words of one name among the other's.

    ``entities`` has ``id, name, type, vector``.
    """
    w = entities.select("id", X.word_set(F.col("name")).alias("w"))
    p = similar_pairs(entities, least, "type", parts)
    p = p.join(w.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return p.where(token_subset(F.col("wa"), F.col("wb"))).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight"))


def tier(score: Column, bounds: tuple[float, ...] = (0.80, 0.85, 0.90, 0.95)) -> Column:
    """Half-open similarity tiers between rising ``bounds``, and those below and above."""
    out = F.lit(f"<{bounds[0]:.2f}")
    for low, high in zip(bounds, (*bounds[1:], None)):
        out = F.when(score >= low, f"{low:.2f}+" if high is None else f"{low:.2f}-{high:.2f}").otherwise(out)
    return out


def token_subset(a: Column, b: Column) -> Column:
    """One array's items all lie in the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
