"""Orphan references: keys that their parent table lacks, lost or got later.

Parent keys are split into a prefix and an integer. Sorted integers of one
prefix are compressed into contiguous runs, and a reference is matched as-of
to the last run that starts at or before it; it is an orphan where that run
ends earlier or none exists. Integers are cut into blocks of ``BLOCK`` so that
every (prefix, block) group holds at most ``BLOCK`` keys whatever the size or
the skew of a prefix: the presence of a block's keys is one ``bit_or`` (partial
aggregation before the shuffle), and its runs are read off that bitmap. A hot
prefix therefore spreads over its blocks, and a hot key on the reference side
is an ordinary equi-join key that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.keys import folded, split_key

#: Integers per block; one bit each in a signed 64-bit word.
BLOCK = 64
_SHIFT = 6


def _blocked(df: DataFrame, key: Column) -> DataFrame:
    prefix, number = split_key(key)
    return (
        df.withColumn("_p", prefix)
        .withColumn("_n", number)
        .withColumn("_b", F.shiftright("_n", _SHIFT))
        .withColumn("_o", F.pmod("_n", F.lit(BLOCK)).cast("int"))
    )



def _runs(bits: str) -> Column:
    """array<struct<start,end>> of the set bits of a 64-bit word, ascending."""
    on = f"(shiftrightunsigned({bits}, i) & 1L) = 1L"
    before = f"(i = 0 or (shiftrightunsigned({bits}, i - 1) & 1L) = 0L)"
    after = f"(i = {BLOCK - 1} or (shiftrightunsigned({bits}, i + 1) & 1L) = 0L)"
    starts = f"filter(sequence(0, {BLOCK - 1}), i -> {on} and {before})"
    ends = f"filter(sequence(0, {BLOCK - 1}), i -> {on} and {after})"
    return F.expr(f"zip_with({starts}, {ends}, (s, e) -> named_struct('start', s, 'end', e))")


def parent_runs(parents: DataFrame, key: Column) -> DataFrame:
    """Contiguous runs of the parent keys: ``_p, _b, runs``.

    Null keys are left out; repeated keys count once; an empty table gives no
    row. Other columns of ``parents`` never reach the result, so clashing names
    do no harm.
    """
    k = parents.select(key.alias("_k")).where("_k is not null")
    return (
        _blocked(k, F.col("_k"))
        .groupBy("_p", "_b")
        .agg(F.expr("bit_or(shiftleft(1L, _o))").alias("bits"))
        .select("_p", "_b", _runs("bits").alias("runs"))
    )


def match_runs(refs: DataFrame, key: Column, runs: DataFrame) -> DataFrame:
    """``refs`` plus boolean ``present``: is the key inside its preceding run?

    A null key gives a null ``present``.
    """
    r = _blocked(refs.withColumn("_k", key), F.col("_k"))
    return (
        r.join(runs, ["_p", "_b"], "left")
        .withColumn("_last", F.expr("case when size(filter(runs, r -> r.start <= _o)) > 0 then element_at(filter(runs, r -> r.start <= _o), -1) end"))
        .withColumn("present", F.when(F.col("_k").isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.col("_last.end") >= F.col("_o"), F.lit(False))))
        .drop("_p", "_b", "_n", "_o", "runs", "_last")
    )


def _doc_of(k: Column) -> Column:
    """What stands in front of ``-cNNNN``; null for a key of another shape."""
    return F.when(k.rlike(r"-c[0-9]+$"), F.regexp_replace(k, r"-c[0-9]+$", ""))


def chunk_orphans(citations: DataFrame, chunks: DataFrame, audit: DataFrame) -> DataFrame:
    """Citations whose chunk is ``missing``, ``deleted`` or ``late``.

    Keys compare without letter case and outer blanks. Null keys are no case.
    ``deleted`` wants a delete or purge row of the chunk or of its document in
    the log, ``late`` a chunk that came in (its own earliest ingest or reingest,
    else its document's) after the citation; a null ``createdAt`` is never late.
    An empty log leaves only ``missing``; empty chunks make every reference an
    orphan.
    """
    refs = citations.select("id", "createdAt", folded(F.col("chunkId")).alias("ref")).where("ref is not null")
    log = audit.select(
        F.lower(F.trim("action")).alias("act"), F.lower(F.trim("entityType")).alias("kind"), folded(F.col("entityId")).alias("ent"), F.col("createdAt").alias("at")
    ).where("act in ('ingest', 'reingest', 'delete', 'purge') and kind in ('chunk', 'document') and ent is not null")
    facts = [F.min(F.when(F.col("act").isin("ingest", "reingest"), F.col("at"))), F.max(F.col("act").isin("delete", "purge"))]
    own = log.where("kind = 'chunk'").groupBy(F.col("ent").alias("ref")).agg(facts[0].alias("own_in"), facts[1].alias("own_gone"))
    docs = log.where("kind = 'document'").groupBy(F.col("ent").alias("doc")).agg(facts[0].alias("doc_in"), facts[1].alias("doc_gone"))
    got = match_runs(refs, F.col("ref"), parent_runs(chunks, folded(F.col("chunkId")))).withColumn("doc", _doc_of(F.col("ref")))
    kind = (
        F.when(~F.col("present") & (F.coalesce("own_gone", F.lit(False)) | F.coalesce("doc_gone", F.lit(False))), "deleted")
        .when(~F.col("present"), "missing")
        .when(F.coalesce("own_in", "doc_in") > F.col("createdAt"), "late")
    )
    return got.join(own, "ref", "left").join(docs, "doc", "left").select("id", F.lit("chunks").alias("target"), "createdAt", kind.alias("kind")).where("kind is not null")


def message_orphans(citations: DataFrame, messages: DataFrame) -> DataFrame:
    """Citations of messages that do not exist; null references are no case."""
    refs = citations.select("id", "createdAt", F.col("messageId").alias("ref")).where("ref is not null")
    got = match_runs(refs, F.col("ref"), parent_runs(messages, F.col("id")))
    return got.where("not present").select("id", F.lit("messages").alias("target"), "createdAt", F.lit("missing").alias("kind"))


def orphan_references(citations: DataFrame, chunks: DataFrame, messages: DataFrame, audit: DataFrame) -> DataFrame:
    """Distinct ``(id, target, period, kind)`` over both targets.

    ``period`` is the month of ``createdAt`` in UTC, whatever the session's time
    zone (null where ``createdAt`` is null).
    """
    both = chunk_orphans(citations, chunks, audit).unionByName(message_orphans(citations, messages))
    return both.select("id", "target", F.date_format(F.to_utc_timestamp("createdAt", F.current_timezone()), "yyyy-MM").alias("period"), "kind").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan citations per target, period and kind."""
    return orphans.groupBy("target", "period", "kind").agg(F.count(F.lit(1)).alias("orphans"))
