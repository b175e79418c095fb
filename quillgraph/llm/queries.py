"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import conversations as CV
from quillgraph.llm import leakage as LE
from quillgraph.llm import lookalikes as LA
from quillgraph.llm import mixing as MI
from quillgraph.llm import names as NA
from quillgraph.llm import packing as PK
from quillgraph.llm import pairs as PA
from quillgraph.llm import quality as QU
from quillgraph.llm import scans as SC


def _load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return NA.same_entity_pairs(_load(spark, d, "ls_import"))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entity and how many spellings that has."""
    c = NA.clusters(NA.name_texts(NA.spans_of(_load(spark, d, "ls_import"))))
    return c.join(c.groupBy("cluster").agg(F.count(F.lit(1)).alias("spellings")), "cluster")


def p1_chunk_mentions(spark: SparkSession, d: str) -> DataFrame:
    return NA.chunk_mentions(_load(spark, d, "ls_import"), _load(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return SC.noise(_load(spark, d, "parsed_elements"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return SC.repaired(_load(spark, d, "parsed_elements"))


def p2_repaired_chunks(spark: SparkSession, d: str) -> DataFrame:
    return SC.repaired_chunks(_load(spark, d, "parsed_elements"), _load(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return PA.pair_defects(_load(spark, d, "messages"))


def p3_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("defect").agg(F.count(F.lit(1)).alias("answers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return CV.judged(_load(spark, d, "messages"), _load(spark, d, "chats")).where("reason is not null")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return CV.ordered_turns(_load(spark, d, "messages"), _load(spark, d, "chats"))


def p5_rescued(spark: SparkSession, d: str) -> DataFrame:
    return CV.rescued(_load(spark, d, "messages"), _load(spark, d, "chats"), 600.0)


def p5_clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    return CV.clock_offsets(CV.one_per_id(_load(spark, d, "messages")), 600.0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    sides = [("chunks", "chunkId", "text"), ("messages", "id", "content")]
    a, b = (LA.same_looking(_load(spark, d, t), k, c).select(F.lit(t).alias("tab"), "id_a", "id_b") for t, k, c in sides)
    return a.unionByName(b)


def p6_one_form(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and messages in their one form: ``tab, id, text``."""
    sides = [("chunks", "chunkId", "text"), ("messages", "id", "content")]
    a, b = (_load(spark, d, t).select(F.lit(t).alias("tab"), F.col(k).alias("id"), F.col(c).alias("text")).distinct() for t, k, c in sides)
    return LA.normalise(a.unionByName(b), "text", "text")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return MI.mixture(_load(spark, d, "documents"), _load(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return MI.mixture(_load(spark, d, "documents"), _load(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return QU.not_prose(_load(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return QU.scored(_load(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    chunks = _load(spark, d, "v2_chunks")
    lanes = max(1, -(-chunks.count() // PK.LANE))
    return PK.containers(PK.element_items(_load(spark, d, "parsed_elements")).unionByName(PK.chunk_items(chunks, lanes)))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return PK.fill_report(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return LE.leaks(_load(spark, d, "documents"), _load(spark, d, "eval_items"))


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return LE.overlaps(_load(spark, d, "documents"), _load(spark, d, "eval_items"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p1_chunk_mentions, p2_found, p2_repaired, p2_repaired_chunks, p3_found, p3_defect_counts, p5_found, p5_conversations, p5_clock_offsets, p5_rescued, p6_found, p6_one_form, p7_containers, p7_fill, p8_found, p8_overlaps, p9_mixture, p9_shares, p10_found, p10_statistics)}
_P5 = r"""
WITH x AS (
  SELECT id, chatId, createdAt AS ts, coalesce(regexp_matches(content, '[\p{L}\p{N}]'), false) AS said,
    CASE WHEN lower(trim(role)) IN ('user','human') THEN 'user' WHEN lower(trim(role)) IN ('assistant','bot','ai') THEN 'assistant' WHEN lower(trim(role))='system' THEN 'system' ELSE 'unknown' END AS kind
  FROM messages
), m AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (ts IS NULL), ts, chatId NULLS FIRST, kind, said) AS r FROM x) WHERE r=1 AND chatId IS NOT NULL
), f AS (
  SELECT chatId, bool_or(kind IN ('user','assistant') AND said) AS spoken, bool_or(ts IS NULL) AS undated, bool_or(kind='unknown') AS unknown FROM m GROUP BY 1
), t AS (
  SELECT chatId, kind, row_number() OVER w AS n, lead(kind) OVER w AS nk, lead(said) OVER w AS ns FROM m WHERE kind<>'system' AND ts IS NOT NULL
  WINDOW w AS (PARTITION BY chatId ORDER BY ts, CASE kind WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, id)
), g AS (
  SELECT chatId, bool_or(n=1 AND kind<>'user') AS odd_start, bool_or(kind='assistant' AND nk='assistant') AS twice, bool_or(kind='user' AND NOT (coalesce(nk,'')='assistant' AND coalesce(ns,false))) AS open FROM t GROUP BY 1
), c AS (SELECT DISTINCT id FROM chats WHERE id IS NOT NULL), a AS (SELECT id AS chatId FROM c UNION SELECT chatId FROM f), j AS (
  SELECT a.chatId, CASE WHEN NOT coalesce(spoken,false) THEN 'empty' WHEN c.id IS NULL OR undated OR unknown OR coalesce(odd_start,false) OR coalesce(twice,false) THEN 'broken' WHEN open THEN 'missing_reply' END AS reason
  FROM a LEFT JOIN f USING (chatId) LEFT JOIN g USING (chatId) LEFT JOIN c ON c.id=a.chatId
) SELECT chatId, reason FROM j WHERE reason IS NOT NULL
"""
SQL: dict[str, str] = {"p5_found": _P5}
