"""Connected components of an undirected graph given as an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import cut_in_loop as cut


def _signature(edges: DataFrame) -> tuple:
    """Number and hash sum of distinct edges: equal for equal sets, one small aggregate."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the smallest node id reachable) for every endpoint.

    Alternating large-star and small-star rounds: each rewires every node's
    larger (smaller) neighbours to its smallest one, so the number of edges
    never grows and the number of rounds is logarithmic in practice. Hub nodes
    are aggregated with partial minima before the shuffle; lineage is cut by a
    checkpoint each round. Null endpoints and self-loops add nothing. It ends
    when a round changes nothing.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    cur = cut(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _signature(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        nxt = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v"))).distinct())
        cur, before, mark = nxt, mark, _signature(nxt)
        if mark == before:
            break
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))
