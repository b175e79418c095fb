"""Queries on dangling references (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators import references as R
from quillgraph.sources.tables import load


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(load(spark, d, "message_citations"), load(spark, d, "chunks"), load(spark, d, "messages"), load(spark, d, "audit_logs"))


def p4_orphans_per_period(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(p4_found(spark, d))


_FOUND = r"""
WITH log AS (
  SELECT lower(trim(action)) act, lower(trim(entityType)) kind, lower(trim(entityId)) ent, createdAt AS ts FROM audit_logs
  WHERE lower(trim(action)) IN ('ingest','reingest','delete','purge')
), own AS (
  SELECT ent, min(ts) FILTER (WHERE act IN ('ingest','reingest')) t_in, bool_or(act IN ('delete','purge')) gone FROM log WHERE kind='chunk' GROUP BY ent
), doc AS (
  SELECT ent, min(ts) FILTER (WHERE act IN ('ingest','reingest')) t_in, bool_or(act IN ('delete','purge')) gone FROM log WHERE kind='document' GROUP BY ent
), refs AS (
  SELECT DISTINCT id, createdAt, lower(trim(chunkId)) ref FROM message_citations WHERE chunkId IS NOT NULL
), keys AS (SELECT DISTINCT lower(trim(chunkId)) k FROM chunks WHERE chunkId IS NOT NULL),
c AS (
  SELECT r.id, r.createdAt,
    CASE WHEN k.k IS NULL AND (coalesce(o.gone,false) OR coalesce(d.gone,false)) THEN 'deleted'
         WHEN k.k IS NULL THEN 'missing'
         WHEN coalesce(o.t_in, d.t_in) > r.createdAt THEN 'late' END kind
  FROM refs r LEFT JOIN keys k ON k.k=r.ref LEFT JOIN own o ON o.ent=r.ref
  LEFT JOIN doc d ON regexp_matches(r.ref,'-c[0-9]+$') AND d.ent=regexp_replace(r.ref,'-c[0-9]+$','')
), f AS (
  SELECT id, 'chunks' AS target, createdAt, kind FROM c WHERE kind IS NOT NULL
  UNION ALL
  SELECT id, 'messages', createdAt, 'missing' FROM message_citations m
  WHERE messageId IS NOT NULL AND NOT EXISTS (SELECT 1 FROM messages x WHERE x.id=m.messageId)
), found AS (SELECT DISTINCT id, target, strftime(createdAt AT TIME ZONE 'UTC','%Y-%m') AS period, kind FROM f)
"""

QUERIES = {"p4_found": p4_found, "p4_orphans_per_period": p4_orphans_per_period}
SQL = {
    "p4_found": _FOUND + "SELECT * FROM found",
    "p4_orphans_per_period": _FOUND + "SELECT target, period, kind, count(*) AS orphans FROM found GROUP BY ALL",
}
