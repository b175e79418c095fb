"""Communities: distributed modularity moves, hierarchy, parents and checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import local_communities as LC
from quillgraph.operators.components import connected_components
from quillgraph.operators.graph import numbered
from quillgraph.operators.metrics import modularity, plurality_parent
from quillgraph.runtime import cut_in_loop as cut

#: Edges that one task may hold as arrays (some 300 MB). Larger connected parts are worked on in distributed rounds until they have shrunk to this.
LOCAL = 2_000_000


def _moves(adj: DataFrame, labels: DataFrame, m2: float, gamma: float, rounds: int, degrees: DataFrame | None = None) -> DataFrame:
    """Local moves by gain of modularity; in each round only half of the nodes (by hash) may move, so neighbours do not swap forever.

    ``degrees`` (``node, k``) are those of the whole graph where ``adj`` holds but a part of its edges.
    """
    deg = cut(adj.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")) if degrees is None else degrees)
    cur = cut(labels.select("node", "label"))
    moved = 0
    for r in range(rounds):
        own = cur.join(deg, "node")
        tot = own.groupBy("label").agg(F.sum("k").alias("tot"))
        to = adj.where("src != dst").join(cur.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
        # the own community is always an option, also without a neighbour in it
        options = to.unionByName(cur.select("node", F.col("label").alias("to"), F.lit(0.0).alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
        o = options.join(own, "node").join(tot.withColumnRenamed("label", "to"), "to")
        stays = F.col("to") == F.col("label")
        gain = F.col("w") - gamma * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
        best = o.withColumn("gain", F.round(gain, 10)).groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), (~stays).cast("int").alias("s"), "to")).alias("m"), F.first("label").alias("label"), F.max(F.when(stays, F.col("gain"))).alias("g0"))
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        nxt = cut(best.select("node", F.when(turn & (-F.col("m.loss") > F.col("g0") + 1e-9), F.col("m.to")).otherwise(F.col("label")).alias("label"), F.col("label").alias("was")))
        moved = nxt.where("label != was").limit(1).count() + (moved if r % 2 else 0)
        cur = nxt.select("node", "label")
        if r % 2 and not moved:  # every node had its turn
            break
    return cur


def _connected(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """Refinement: every community falls into its connected parts, named by their smallest node."""
    l = labels.select("node", "label")
    inner = adj.join(l.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(l.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst")
    c = connected_components(inner)
    return l.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def _refined(adj: DataFrame, labels: DataFrame, m2: float, gamma: float, rounds: int) -> DataFrame:
    """Refinement: inside every community its nodes start alone and move once more, to neighbours of the same community only; parts stay connected."""
    l = cut(labels.select("node", "label"))
    inner = adj.join(l.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(l.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", "weight")
    inner = cut(inner)
    deg = adj.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    alone = l.select("node", F.col("node").alias("label"))
    return _connected(inner, _moves(inner, alone, m2, gamma, rounds, deg))


def dense_labels(labels: DataFrame) -> DataFrame:
    """``node, label`` with labels 0, 1, 2 ... in the order in which the nodes, sorted, first show them."""
    first = labels.groupBy("label").agg(F.min("node").alias("first"))
    at = numbered(first.select("first"), "first").select("first", F.col("idx").alias("dense"))
    return labels.join(first.join(at, "first").select("label", "dense"), "label").select("node", F.col("dense").alias("label"))


def sweep(adj: DataFrame, gammas: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), rounds: int = 12) -> DataFrame:
    """``gamma, communities, modularity`` of the finest partition at several resolutions."""
    out = None
    for g in gammas:
        parts = hierarchy(adj, g, rounds)
        if not parts:
            raise ValueError("the graph has no edges")
        p = parts[0]
        row = p.agg(F.count_distinct("label").alias("communities")).crossJoin(modularity(adj, p)).select(F.lit(float(g)).alias("gamma"), "communities", "modularity")
        out = row if out is None else out.unionByName(row)
    return out


def _finished(adj: DataFrame, start: DataFrame | None, bins: int, m2: float, gamma: float, rounds: int, levels: int) -> DataFrame:
    """``node, labels``: the levels of graphs that fit into tasks, one label each. ``adj`` has ``own, lane`` (the task's key) too."""
    kind = dict(adj.dtypes)["src"]
    e = adj.where("src <= dst").select("own", "lane", "src", "dst", "weight", F.xxhash64("src").alias("hs"), F.xxhash64("dst").alias("ht"))
    if start is not None:
        for c, new in (("src", "ls"), ("dst", "lt")):
            e = e.join(start.select(F.col("node").alias(c), F.col("label").alias(new)), c)
    fresh = start is None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = len(pdf)
        ids, at = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        h, begin = np.empty(len(ids), np.int64), np.arange(len(ids))
        h[at[:m]], h[at[m:]] = pdf["hs"], pdf["ht"]
        if not fresh:
            begin[at[:m]], begin[at[m:]] = np.searchsorted(ids, pdf["ls"].to_numpy()), np.searchsorted(ids, pdf["lt"].to_numpy())
        out = LC.levels(at[:m], at[m:], pdf["weight"].to_numpy(), h.view(np.uint64), begin, m2, gamma, rounds, levels, fresh)
        labels = list(ids[np.array(out).T]) if out else [[]] * len(ids)
        return pd.DataFrame({"node": ids, "labels": labels})

    return cut(e.repartition(max(1, 2 * bins), "own", "lane").groupBy("own", "lane").applyInPandas(run, f"node {kind}, labels array<{kind}>"))


def _steps(done: DataFrame) -> list[DataFrame]:
    """``node, label`` per level; where a graph has ended its last level stands."""
    n = done.agg(F.max(F.size("labels"))).first()[0] or 0
    return [done.select("node", F.expr(f"labels[least({i}, size(labels) - 1)]").alias("label")) for i in range(n)]


def hierarchy(adj: DataFrame, gamma: float = 1.0, rounds: int = 12, levels: int = 10) -> list[DataFrame]:
    """Partitions ``node, label`` from fine to coarse; nodes may be integers or strings, ``adj`` holds both directions.

    Per level: local moves; refinement by moves inside each community; the
    refined parts become the next level's nodes, which start in the community
    they came from. It ends when modularity gains no more. Connected parts of
    the graph do not touch each other: those of up to ``LOCAL`` edges are
    worked on as arrays, many tasks side by side. For larger ones every step is
    a join or an aggregate until the level's graph is that small, so no task
    holds a graph of unbounded size.
    """
    adj = cut(adj.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    size, m2 = adj.agg(F.sum((F.col("src") <= F.col("dst")).cast("bigint")), F.sum("weight")).first()
    if not m2:
        return []
    one = (F.lit(None).cast("string").alias("own"), F.lit(0).alias("lane"))
    if size <= LOCAL:
        return _steps(_finished(adj.select("*", *one), None, 1, m2, gamma, rounds, levels))
    c = connected_components(adj.where("src <= dst"))
    e = cut(adj.join(c.select(F.col("node").alias("src"), "component"), "src"))
    sizes = cut(e.where("src <= dst").groupBy("component").agg(F.count(F.lit(1)).alias("edges")))
    # a part of an eighth of the bound has a task of its own, the others share tasks by hash
    alone = F.col("edges") > LOCAL // 8
    fits = F.col("edges") <= LOCAL
    few, owns, rest = sizes.agg(F.count(F.when(fits, 1)), F.count(F.when(fits & alone, 1)), F.sum(F.when(~alone, F.col("edges")).otherwise(0))).first()
    lanes = -(-2 * rest // LOCAL) if rest else 0
    small = large = []
    if few:
        key = sizes.where(fits).select("component", F.when(alone, F.col("component").cast("string")).alias("own"), F.when(alone, -1).otherwise(F.pmod(F.xxhash64("component"), F.lit(max(1, lanes)))).cast("int").alias("lane"))
        small = _steps(_finished(e.join(key, "component"), None, owns + lanes, m2, gamma, rounds, levels))
    if few < sizes.count():
        large = _large(cut(e.join(sizes.where(~fits), "component", "left_semi").select("src", "dst", "weight")), m2, gamma, rounds, levels)
    n = max(len(small), len(large))
    pairs = [[p[min(i, len(p) - 1)] for p in (small, large) if p] for i in range(n)]
    return [p[0] if len(p) == 1 else p[0].unionByName(p[1]) for p in pairs]


def _large(adj: DataFrame, m2: float, gamma: float, rounds: int, levels: int) -> list[DataFrame]:
    """The levels of a graph that no task can hold, in distributed rounds; ``m2`` is the sum of weights of the graph that it belongs to."""
    out: list[DataFrame] = []
    nodes = adj.select(F.col("src").alias("node")).distinct()
    base, level_adj, best = cut(nodes.select("node", F.col("node").alias("label"))), adj, None
    start = base
    for level in range(levels):
        if level and level_adj.where("src <= dst").count() <= LOCAL:
            done = _finished(level_adj.select("*", F.lit(None).cast("string").alias("own"), F.lit(0).alias("lane")), start, 1, m2, gamma, rounds, levels - level)
            last = cut(base.withColumnRenamed("label", "part").join(done.withColumnRenamed("node", "part"), "part").select("node", "labels"))
            return out + _steps(last)
        part = cut(_connected(level_adj, _moves(level_adj, start, m2, gamma, rounds)))
        flat = cut(base.join(part.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label")))
        q = modularity(adj, flat, gamma).first()[0]
        if best is not None and q <= best + 1e-9:
            break
        out.append(flat)
        best = q
        if part.where("node != label").limit(1).count() == 0:
            break
        fine = cut(_refined(level_adj, part, m2, gamma, rounds))
        base = cut(base.join(fine.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label")))
        # a refined part is a node of the next level and starts where its members are; communities are called by their smallest part
        whole = fine.join(part.select("node", F.col("label").alias("up")), "node").groupBy(F.col("label").alias("part")).agg(F.min("up").alias("up"))
        names = whole.groupBy("up").agg(F.min("part").alias("name"))
        start = cut(whole.join(names, "up").select(F.col("part").alias("node"), F.col("name").alias("label")))
        s, t = fine.select(F.col("node").alias("src"), F.col("label").alias("a")), fine.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        level_adj = cut(level_adj.join(s, "src").join(t, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
    return out


def long_hierarchy(parts: list[DataFrame]) -> DataFrame:
    """``level, node, label`` with level 0 the coarsest."""
    out = None
    for level, p in enumerate(reversed(parts)):
        part = p.select(F.lit(level).alias("level"), "node", "label")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the graph has no edges")
    return out


def community_id(corpus: str, level: str = "level", label: str = "label"):
    return F.format_string(f"{corpus}-L%d-c%d", F.col(level), F.col(label))


def parents(levels: DataFrame) -> DataFrame:
    """``level, child, parent``: each community's plurality parent one level up."""
    up = levels.select((F.col("level") + 1).alias("level"), "node", F.col("label").alias("parent"))
    j = levels.select("level", "node", F.col("label").alias("child")).join(up, ["level", "node"])
    n = j.groupBy("level", "child", "parent").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("level", "child").agg(F.min(F.struct((-F.col("n")).alias("k"), "parent")).alias("m")).select("level", "child", "m.parent")


def disconnected_share(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of communities that fall into several parts."""
    parts = _connected(adj, labels).withColumnRenamed("label", "part").join(labels.select("node", "label"), "node")
    c = parts.groupBy("label").agg(F.count_distinct("part").alias("parts"))
    return c.agg(F.avg((F.col("parts") > 1).cast("double")).alias("disconnected"))


def community_of(c: str = "community"):
    """``corpus, level, label`` of a community id."""
    p = r"^(.*)-L([0-9]+)-c(.+)$"
    return F.struct(F.regexp_extract(c, p, 1).alias("corpus"), F.regexp_extract(c, p, 2).cast("int").alias("level"), F.regexp_extract(c, p, 3).alias("label"))


__all__ = ["community_id", "community_of", "dense_labels", "sweep", "disconnected_share", "hierarchy", "long_hierarchy", "modularity", "parents", "plurality_parent"]
