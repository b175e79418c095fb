"""Property-graph operators on edge lists ``src, dst, weight``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.operators import trails
from quillgraph.runtime import cut

#: Entities above which a chunk is split in the co-mention join.
HOT = 2_000
#: Entities in an array of ``comention_steps`` at most.
PIECE = 250
#: Seeds whose walks are added up together, neighbours in a row at most, and steps that a task holds at once.
SEEDS, ROW, STEPS = 32, 1_000, 4_000_000
#: Seeds whose neighbourhood one task gets, at least where there are enough and at most, and steps of such a neighbourhood at most.
FEW, MANY, HELD = 32, 256, 16_000_000


def comention_edges(mentions: DataFrame, chunk: str = "chunk", entity: str = "entity", parts: int = 8) -> DataFrame:
    """Entities that share a chunk: ``src < dst`` with the number of shared chunks as weight.

    The self-join is keyed by chunk and, for chunks of more than ``HOT``
    entities, by a cell of their left side too, so that the m(m-1)/2 pairs of a
    hot chunk come from ``parts`` tasks. Repeated mentions count once; pairs are
    summed before the shuffle.
    """
    m = mentions.select(F.col(chunk).alias("c"), F.col(entity).alias("e")).where("c is not null and e is not null").distinct()
    hot = m.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("c", F.lit(parts).alias("k"))
    k = F.coalesce("k", F.lit(1))
    m = m.join(hot, "c", "left")
    left = m.select("c", "e", F.pmod(F.xxhash64("e"), k).cast("int").alias("cell"))
    right = m.select("c", F.col("e").alias("f"), F.explode(F.sequence(F.lit(0), k - 1)).alias("cell"))
    return left.join(right, ["c", "cell"]).where("e < f").groupBy(F.col("e").alias("src"), F.col("f").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def comention_steps(mentions: DataFrame, chunk: str = "chunk", entity: str = "entity") -> DataFrame:
    """``node, to``: the other entities of each chunk that holds ``node``, as an array; the edges of ``comention_edges`` both ways.

    One row per mention instead of one per pair; a pair that shares several
    chunks is in several rows. The entities of a chunk of more than ``PIECE``
    are paired piece by piece, in many tasks.
    """
    m = mentions.select(F.col(chunk).alias("c"), F.col(entity).alias("e")).where("c is not null and e is not null")
    lists = m.groupBy("c").agg(F.collect_set("e").alias("all")).select("all")
    pieces = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(PIECE)), lambda i: F.slice("all", i, PIECE))
    long = lists.where(F.size("all") > PIECE).select(pieces.alias("all"))
    long = long.select("all", F.explode("all").alias("some")).select(F.explode("all").alias("all"), "some").repartition(F.hash("all", "some"))
    rows = lists.where(F.size("all").between(2, PIECE)).select("all", F.col("all").alias("some")).unionByName(long)
    return rows.select("all", F.explode("some").alias("node")).select("node", F.array_remove("all", F.col("node")).alias("to"))


def edges_of(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Edge scan: a missing or null weight is 1."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("weight"))


def adjacency(edges: DataFrame, undirected: bool = True) -> DataFrame:
    """Matrix entries: parallel edges add up; undirected edges enter both ways (a self-loop twice)."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if undirected else e
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"), F.count(F.lit(1)).alias("neighbours"))


def numbered(values: DataFrame, column: str) -> DataFrame:
    """``column, idx``: contiguous positions from 0 over the sorted, distinct, non-null values.

    Positions are a range's offset (prefix sum of range sizes) plus the place
    inside the range, so no single task numbers all nodes.
    """
    v = values.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = cut(v.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    place = ranged.withColumn("place", F.row_number().over(W.Window.partitionBy("part").orderBy(column)) - 1)
    return place.join(before, "part").select(column, (F.col("before") + F.col("place")).cast("bigint").alias("idx"))


def node_index(edges: DataFrame) -> DataFrame:
    """``node, idx``: contiguous positions over the sorted distinct endpoints."""
    return numbered(edges.select(F.col("src").alias("node")).union(edges.select("dst")), "node")


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours ``node, neighbour`` without loops."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    return e.union(e.select("neighbour", "node")).where("node != neighbour").distinct()


def induced_edges(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among ``nodes``: two semi-joins, never a cross product."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(n, F.col("src") == F.col("_n"), "left_semi").join(n, F.col("dst") == F.col("_n"), "left_semi")


def khop(edges: DataFrame, seeds: DataFrame, hops: int, node: str = "node") -> DataFrame:
    """``node, hop`` of all nodes within ``hops`` undirected steps of the seeds (0 for a seed)."""
    near = neighbours(edges)
    seen = seeds.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        nxt = frontier.join(near, "node").select(F.col("neighbour").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(h))
        frontier = cut(nxt) if h < hops else nxt
        seen = seen.unionByName(frontier)
    return seen


def trail_paths(edges: DataFrame, seeds: DataFrame, hops: int, node: str = "node") -> DataFrame:
    """All paths of 1..``hops`` undirected steps from the seeds that repeat no edge.

    ``edges`` has ``edge_id, src, dst``; nodes may be visited again. Result:
    ``seed, target, nodes, edges, hops``. Each further hop is one equi-join on
    the current end; bound hubs by degree or weight beforehand.
    """
    step = edges.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(edges.where("src != dst").select("edge_id", F.col("dst").alias("node"), F.col("src").alias("to")))
    start = seeds.select(F.col(node).alias("node")).distinct().join(step, "node")
    cur = start.select(F.col("node").alias("seed"), F.col("to").alias("target"), F.array("node", "to").alias("nodes"), F.array("edge_id").alias("edges"))
    out = cur.withColumn("hops", F.lit(1))
    for h in range(2, hops + 1):
        nxt = cur.join(step, cur["target"] == step["node"]).where(~F.expr("array_contains(edges, edge_id)"))
        cur = nxt.select("seed", F.col("to").alias("target"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"))
        out = out.unionByName(cur.withColumn("hops", F.lit(h)))
    return out


def _added(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """``seed, target, n`` of rows ``g, seeds, m, to, n`` of one group: the sums over rows of m times n (below 2^53)."""
    r = pa.Table.from_batches(rows).combine_chunks()
    flat = lambda c: r[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    length = lambda c: r[c].combine_chunks().value_lengths().to_numpy()
    seeds, which = np.unique(flat("seeds"), return_inverse=True)
    targets, at = np.unique(flat("to"), return_inverse=True)
    row, m, n, reps = np.repeat(np.arange(len(r)), length("seeds")), flat("m"), flat("n"), length("to")
    found = []
    for i in range(len(seeds)):
        x = np.bincount(row[which == i], m[which == i], len(r))
        s = np.bincount(at, np.repeat(x, reps) * n, len(targets))
        hit = np.flatnonzero(s)
        found.append((np.full(len(hit), i), hit, s[hit]))
    i, hit, s = (np.concatenate(x) for x in zip(*found))
    kind = r.schema.field("to").type.value_type
    return pa.RecordBatch.from_arrays([pa.array(seeds[i], kind), pa.array(targets[hit], kind), pa.array(s.astype(np.int64))], ["seed", "target", "n"])


def _added_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows sorted by ``g``, some millions of steps at a time."""
    held, steps, last = [], 0, None
    for b in batches:
        g = b["g"].to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and (g[lo] != last or steps > STEPS):
                yield _added(held)
                held, steps = [], 0
            part, last = b.slice(lo, hi - lo), g[lo]
            held.append(part)
            steps += len(part["to"].flatten())
    if held:
        yield _added(held)


def _next_walks(walks: DataFrame, a: DataFrame) -> DataFrame:
    """``seed, target, n`` one hop further, in parts that are still to be added up.

    Groups of seeds share the rows of their nodes' neighbours; the products are
    added up in arrays, so no row is made for a walk.
    """
    g = numbered(walks, "seed").select("seed", F.floor(F.col("idx") / SEEDS).alias("g"))
    groups = -(-walks.select("seed").distinct().count() // SEEDS)
    x = walks.join(g, "seed").groupBy("g", F.col("target").alias("node")).agg(F.collect_list(F.struct("seed", F.col("n").alias("m"))).alias("x"))
    cells = a.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / ROW).alias("cells"))
    y = a.join(cells, "node").groupBy("node", F.pmod(F.xxhash64("to"), F.col("cells")).alias("cell")).agg(F.collect_list(F.struct("to", "n")).alias("y"))
    rows = x.join(y, "node").select("g", F.col("x.seed").alias("seeds"), "x.m", "y.to", "y.n")
    kind = dict(a.dtypes)["to"]
    return rows.repartition(max(1, min(2 * groups, 2_000)), "g").sortWithinPartitions("g").mapInArrow(_added_groups, f"seed {kind}, target {kind}, n bigint")


def _walked(a: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """The counts of ``trail_counts`` from steps ``node, to, n`` by walks as rows, one per seed and node."""
    d = a.groupBy("node").agg(F.sum("n").alias("d"))
    one = cut(a.join(starts, "node", "left_semi").select(F.col("node").alias("seed"), F.col("to").alias("target"), "n"))
    walks = [one]
    if hops > 1:
        w = walks[-1].withColumnRenamed("n", "m").join(a, F.col("target") == F.col("node")).groupBy("seed", F.col("to").alias("target")).agg(F.sum(F.col("m") * F.col("n")).alias("n"))
        walks.append(cut(w))
    if hops > 2:
        walks.append(_next_walks(walks[-1], a))
    out = one.withColumn("hops", F.lit(1))
    if hops > 1:
        back = starts.join(d, "node").select(F.col("node").alias("seed"), F.col("node").alias("target"), (-F.col("d")).alias("n"))
        out = out.unionByName(walks[1].unionByName(back).groupBy("seed", "target").agg(F.sum("n").alias("n")).withColumn("hops", F.lit(2)))
    if hops > 2:
        near = one.join(d.select(F.col("node").alias("seed"), F.col("d").alias("ds")), "seed").join(d.select(F.col("node").alias("target"), F.col("d").alias("dt")), "target")
        again = near.select("seed", "target", (F.col("n") * (2 - F.col("ds") - F.col("dt")) - F.when(F.col("seed") != F.col("target"), F.col("n") * F.col("n")).otherwise(0)).alias("n"))
        loops = a.where("node = to").select(F.col("node").alias("target"), F.col("n").alias("l"))
        round_ = one.join(loops, "target").select("seed", F.col("seed").alias("target"), (-F.col("n") * F.col("l")).alias("n"))
        out = out.unionByName(walks[2].unionByName(again).unionByName(round_).groupBy("seed", "target").agg(F.sum("n").alias("n")).withColumn("hops", F.lit(3)))
    return out.where("n > 0").select("seed", "target", "hops", F.col("n").alias("paths"))


def trail_counts(edges: DataFrame, seeds: DataFrame, hops: int, node: str = "node") -> DataFrame:
    """``seed, target, hops, paths``: how many of ``trail_paths`` there are, for up to 3 hops, without listing one.

    Walks are counted hop by hop. From them go those that use an edge twice:
    with A(s, t) the edges between two nodes and d the steps from a node, the
    first and second edge agree in d(s) A(s, t) walks of three hops, the second
    and third in A(s, t) d(t), the first and third in A(s, t)^2 (at s = t in the
    sum of A(s, a) A(a, a)); all three agree in A(s, t), which has then gone
    once too often twice.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    there, back = F.struct(F.col("src").alias("node"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("node"), F.col("src").alias("to"))
    step = e.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))).alias("s")).select("s.node", "s.to")
    if dict(step.dtypes)["node"] not in ("tinyint", "smallint", "int", "bigint"):
        _counted_hops(hops)
        return _walked(cut(step.groupBy("node", "to").agg(F.count(F.lit(1)).alias("n"))), seeds.select(F.col(node).alias("node")).distinct(), hops)
    return trail_counts_of_steps(step.select("node", F.array("to").alias("to")), seeds, hops, node)


def _counted_hops(hops: int) -> None:
    if not 1 <= hops <= 3:
        raise ValueError("trails are counted for 1 to 3 hops")


def trail_counts_of_steps(steps: DataFrame, seeds: DataFrame, hops: int, node: str = "node", once: bool = False) -> DataFrame:
    """``trail_counts`` of the undirected steps ``node, to`` (integers; ``to`` an array; a loop once), with ``once`` each edge counted once however often it comes.

    Each node gets one packed row of its neighbours. A group of seeds gets the
    rows of all nodes fewer than ``hops`` steps away, and one task adds up their
    walks in arrays: no walk is shuffled. Groups with more than ``HELD`` steps
    around them are divided; a seed that alone has more is counted by rows.
    """
    _counted_hops(hops)
    kind = dict(steps.dtypes)["node"]
    long = steps.select(F.col("node").cast("bigint").alias("node"), F.col("to").cast("array<bigint>").alias("to"))
    rows = cut(long.repartition("node").sortWithinPartitions("node").mapInArrow(partial(trails.merged, once=once), trails.ROWS))
    starts = cut(seeds.select(F.col(node).cast("bigint").alias("node")).where("node is not null").distinct().join(rows.select("node"), "node", "left_semi"))
    count, out = starts.count(), None
    size = min(MANY, max(FEW, -(-count // 16)))
    while count:
        grouped = cut(numbered(starts, "node").select(F.floor(F.col("idx") / size).alias("g"), "node"))
        near = grouped
        for _ in range(hops - 1):
            sets = near.join(rows, "node").select("g", "node", "to").mapInArrow(trails.reached, "node bigint, to binary")
            near = sets.repartition("node").sortWithinPartitions("node").mapInArrow(partial(trails.merged, once=True), trails.ROWS)
            near = cut(near).mapInArrow(trails.listed, "g bigint, node bigint")
        large = cut(near.join(rows.select("node", "size"), "node").groupBy("g").agg(F.sum("size").alias("size")).where(F.col("size") > HELD).select("g"))
        groups = -(-count // size)
        over = large.count()
        if over:
            near, grouped, starts = near.join(large, "g", "left_anti"), grouped.join(large, "g", "left_anti"), cut(grouped.join(large, "g", "left_semi").select("node"))
        if over < groups:
            given = near.join(rows, "node").select("g", "node", "to", "n").unionByName(grouped.select("g", "node", F.lit(None).cast("binary").alias("to"), F.lit(None).cast("binary").alias("n")))
            found = given.repartition(max(1, min(2 * (groups - over), 2_000)), "g").sortWithinPartitions("g").mapInArrow(partial(trails.counted, hops=hops), trails.COUNTS)
            out = found if out is None else out.unionByName(found)
        if over and size == 1:
            found = _walked(cut(rows.mapInArrow(trails.spread, "node bigint, to bigint, n bigint")), starts, hops)
            out = found if out is None else out.unionByName(found)
        count = starts.count() if over and size > 1 else 0
        size = max(1, size // 8)
    if out is None:
        out = steps.sparkSession.createDataFrame([], trails.COUNTS)
    return out.select(F.col("seed").cast(kind), F.col("target").cast(kind), "hops", "paths")


def union_layers(layers: Iterable[tuple[DataFrame, float | None]]) -> DataFrame:
    """Edge layers with their own weights, or a constant one where given."""
    out = None
    for df, constant in layers:
        e = df.select("src", "dst", (F.col("weight").cast("double") if constant is None else F.lit(float(constant))).alias("weight"))
        out = e if out is None else out.unionByName(e)
    if out is None:
        raise ValueError("no edge layer is chosen")
    return out


def hop_label(hop: Column) -> Column:
    return F.when(hop == 0, "seed").when(hop == 1, "1").otherwise("2+")


def pick(nodes: DataFrame, node: str = "node", seed: int = 1) -> DataFrame:
    """One node at random by a seeded hash: the same one for the same nodes and seed."""
    return nodes.select(node).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(node).cast("string"))), node).limit(1)


def expanded(nodes: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Nodes shown so far and new ones, one row per key; those shown stay as they are."""
    return nodes.unionByName(more.join(nodes.select(key), key, "left_anti").dropDuplicates([key]).select(nodes.columns))


def path_filter(paths: DataFrame, edges: DataFrame, every: list[str] | None = None, none: list[str] | None = None) -> DataFrame:
    """Paths all of whose edges have a type of ``every``, and none of whose edges has one of ``none``."""
    on = paths.select("path_id", F.explode("edges").alias("edge_id")).join(edges.select("edge_id", "type"), "edge_id")
    bad = on.where((~F.col("type").isin(every) if every is not None else F.lit(False)) | (F.col("type").isin(none) if none is not None else F.lit(False)))
    return paths.join(bad.select("path_id").distinct(), "path_id", "left_anti")


def scoped(df: DataFrame, scope: str | list[str] | None, *columns: str) -> DataFrame:
    """Keeps rows whose columns all lie in the scope: none filters nothing, a list means any of it."""
    for c in columns:
        if scope is not None:
            df = df.where(F.col(c) == scope if isinstance(scope, str) else F.col(c).isin(list(scope)))
    return df
