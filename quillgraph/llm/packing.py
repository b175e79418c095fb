"""Filling fixed-capacity containers (problem 7).

Items of a group are cut into lanes (runs of their order, or hash lanes) that
are packed independently. In a lane, every source has a queue sorted by size
and a deficit: what its target share of all windows so far grants it, less what
it has placed. A window (container) is filled by deficit round-robin: the
source that is owed most places its largest item that still fits; when none of
its items fits the next one is asked. Deficits go on from window to window; a
lane starts with the deficits that all lanes before it leave, which follow from
their totals (a prefix sum), so lanes need not wait for each other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Items of a lane at most (by order) or on average (by hash).
LANE = 2048

_OUT = T.StructType(
    [
        T.StructField("grp", T.StringType()), T.StructField("container", T.StringType()), T.StructField("used", T.LongType()), T.StructField("fill", T.DoubleType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())]))),
    ]
)


def pack_lane(items: list[tuple[str, str, int]], deficit: dict[str, float], share: dict[str, float], capacity: int) -> list[list[tuple[str, int, str, int]]]:
    """Containers of ``(item, piece, source, tokens)`` for the items ``(item, source, tokens)`` of one lane.

    Only an item above the capacity is split: into full containers and a rest,
    which is packed like any item. Items without tokens join a container.
    """
    owed = dict(deficit)
    out: list[list[tuple[str, int, str, int]]] = []
    queues: dict[str, list[tuple[int, int, str]]] = {}
    for item, source, tokens in items:
        piece = 0
        while tokens > capacity:
            out.append([(item, piece, source, capacity)])
            owed[source] = owed.get(source, 0.0) - capacity
            for s, x in share.items():
                owed[s] = owed.get(s, 0.0) + x * capacity
            tokens -= capacity
            piece += 1
        queues.setdefault(source, []).append((tokens, piece, item))
    for q in queues.values():
        q.sort()
    left = sum(map(len, queues.values()))
    while left:
        room, window = capacity, []
        for s, x in share.items():
            owed[s] = owed.get(s, 0.0) + x * capacity
        while left:
            best = None
            for s in sorted(queues, key=lambda s: (-owed.get(s, 0.0), s)):
                q = queues[s]
                k = bisect_right(q, (room, np.iinfo(np.int32).max, ""))
                if k:
                    best = (s, k - 1)
                    break
            if best is None:
                break
            s, k = best
            tokens, piece, item = queues[s].pop(k)
            if not queues[s]:
                del queues[s]
            left -= 1
            window.append((item, piece, s, tokens))
            owed[s] = owed.get(s, 0.0) - tokens
            room -= tokens
        out.append(window)
    return out


def _lanes(capacity: int):
    def flush(key: tuple[str, int], rows: dict[str, list]) -> list[tuple]:
        deficit, share, items = {}, {}, []
        for item, source, tokens, owed, part in zip(*(rows[c] for c in ("item", "source", "tokens", "owed", "share"))):
            if item is None and part is not None and part == part:
                deficit[source], share[source] = owed, part
            else:
                items.append((item, source, int(tokens)))
        out = []
        for n, c in enumerate(pack_lane(items, deficit, share, capacity)):
            used = sum(x[3] for x in c)
            out.append((key[0], f"{key[0]}#{key[1]}-{n:05d}", used, used / capacity, [{"item": i, "piece": p, "source": s, "tokens": t} for i, p, s, t in c]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, None
        columns = [f.name for f in _OUT.fields]
        for b in batches:
            out = []
            grp, lane = b["grp"].to_numpy(), b["lane"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (lane[1:] != lane[:-1])]) if len(b) else []
            cols = {c: b[c].to_list() for c in ("item", "source", "tokens", "owed", "share")}
            for s, e in zip(starts, [*starts[1:], len(b)]):
                k = (grp[s], int(lane[s]))
                part = {c: v[s:e] for c, v in cols.items()}
                if key == k:
                    for c in part:
                        rows[c] += part[c]
                else:
                    if key is not None:
                        out += flush(key, rows)
                    key, rows = k, part
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame(flush(key, rows), columns=columns)

    return run


def containers(items: DataFrame, capacity: int = 512, targets: DataFrame | None = None) -> DataFrame:
    """Containers of all items: ``grp, container, used, fill, items``.

    ``items`` has ``grp, lane, item, source, tokens``. Every row is an item,
    also where rows repeat; a null group, source or item becomes the text
    ``none``; null or negative tokens count as 0. Target shares are those of
    ``targets`` (``source, share``; of one source the largest counts, others
    get none), brought to a sum of 1 among the group's sources, or else the
    group's own shares of tokens. An empty table gives no row.
    """
    i = items.select(
        F.coalesce("grp", F.lit("none")).alias("grp"), F.coalesce("lane", F.lit(0)).cast("bigint").alias("lane"), F.coalesce("item", F.lit("none")).alias("item"), F.coalesce("source", F.lit("none")).alias("source"),
        F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"),
    )
    per = i.groupBy("grp", "lane", "source").agg(F.sum("tokens").alias("t"))
    whole = per.groupBy("grp", "source").agg(F.sum("t").alias("st"))
    if targets is not None:
        t = targets.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.max("share").alias("w"))
        whole = whole.join(t, "source", "left").select("grp", "source", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("st"))
    share = whole.withColumn("share", F.col("st") / F.nullif(F.sum("st").over(W.Window.partitionBy("grp")).cast("double"), F.lit(0.0))).select("grp", "source", F.coalesce("share", F.lit(0.0)).alias("share"))
    lanes = per.groupBy("grp", "lane").agg(F.sum("t").alias("lt"))
    grid = lanes.join(share, "grp").join(per, ["grp", "lane", "source"], "left").withColumn("gap", F.col("share") * F.col("lt") - F.coalesce("t", F.lit(0)))
    owed = grid.withColumn("owed", F.coalesce(F.sum("gap").over(W.Window.partitionBy("grp", "source").orderBy("lane").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0)))
    heads = owed.select("grp", "lane", F.lit(None).cast("string").alias("item"), "source", F.lit(0).cast("bigint").alias("tokens"), "owed", "share")
    body = i.withColumns({"owed": F.lit(0.0), "share": F.lit(None).cast("double")})
    rows = heads.unionByName(body).repartition("grp", "lane").sortWithinPartitions("grp", "lane", F.col("item").isNotNull())
    return rows.mapInPandas(_lanes(capacity), _OUT)


def element_items(elements: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """Parsed elements as items: grouped by document, in lanes of their reading order, one source per element type."""
    seq = F.regexp_extract("elementId", r"([0-9]{1,18})$", 1).try_cast("bigint")
    # elements without a number have no order and are dealt over hash lanes of their own
    plain = elements.where(seq.isNull()).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    lane = F.coalesce(F.floor(seq / LANE), -1 - F.pmod(F.xxhash64("elementId"), F.lit(max(1, -(-plain // LANE)))))
    return elements.select(
        F.col("docName").alias("grp"), lane.alias("lane"), F.col("elementId").alias("item"), F.col("elementType").alias("source"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / chars_per_token).alias("tokens")
    )


def chunk_items(chunks: DataFrame, lanes: int, chars_per_token: int = 4) -> DataFrame:
    """Chunks with an estimate as items of one group in hash lanes; an estimate that is no positive number is replaced by one from the length."""
    est = F.when(F.col("token_estimate") > 0, F.col("token_estimate").cast("bigint")).otherwise(F.ceil(F.length(F.coalesce("content", F.lit(""))) / chars_per_token))
    return chunks.select(F.lit("v2_chunks").alias("grp"), F.pmod(F.xxhash64("chunk_id", "token_estimate"), F.lit(lanes)).alias("lane"), F.col("chunk_id").alias("item"), F.col("element_type").alias("source"), est.alias("tokens"))


def fill_report(packed: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per group: containers, tokens, mean fill, the share of room left over, and how far containers are from the target shares.

    ``share_error`` is the mean, over containers with tokens, of the share of
    their tokens that would have to come from other sources (half the sum of
    the differences); items that are large against the capacity bound it from
    below. ``targets`` as in :func:`containers`, else the group's own shares.
    """
    flat = packed.select("grp", "container", "used", F.explode("items").alias("x")).groupBy("grp", "container", "used", F.col("x.source").alias("source")).agg(F.sum("x.tokens").alias("t"))
    whole = flat.groupBy("grp", "source").agg(F.sum("t").alias("w"))
    if targets is not None:
        t = targets.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.max("share").alias("p"))
        whole = whole.join(t, "source", "left").select("grp", "source", F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = F.nullif(F.sum("w").over(W.Window.partitionBy("grp")).cast("double"), F.lit(0.0))
    share = whole.withColumn("share", F.coalesce(F.col("w") / total, F.lit(0.0))).select("grp", "source", "share")
    # the shares sum to 1 on both sides, so what is above its target tells the whole difference
    over = flat.where("used > 0").join(share, ["grp", "source"]).groupBy("grp", "container").agg(F.sum(F.greatest(F.col("t") / F.col("used") - F.col("share"), F.lit(0.0))).alias("e")).groupBy("grp").agg(F.avg("e").alias("share_error"))
    filled = packed.groupBy("grp").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.avg("fill").alias("mean_fill"), (1 - F.avg("fill")).alias("left_over"))
    return filled.join(over, "grp", "left")
