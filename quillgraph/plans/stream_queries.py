"""Streaming jobs run to the end of their input, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.runtime import shared_folder
from quillgraph.sources.tables import load
from quillgraph.streaming import jobs as J


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


def _events(spark, d):
    return J.files(spark, f"{d}/events*.parquet", load(spark, d, "events").schema)


def audit_append_stream(spark, d):
    out = _folder(spark)
    J.append(_events(spark, d), out + "/log", out + "/ckpt").awaitTermination()
    return spark.read.parquet(out + "/log").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def publish_foreachbatch(spark, d):
    out = _folder(spark)
    s = J.files(spark, f"{d}/chunks*.parquet", load(spark, d, "chunks").schema)
    J.publish(s, out + "/chunks", ["chunkId"], out + "/ckpt").awaitTermination()
    return spark.read.parquet(out + "/chunks").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("docName").alias("docs"))


def debounce_state(spark, d):
    out = _folder(spark)
    m = J.files(spark, f"{d}/messages*.parquet", load(spark, d, "messages").schema)
    q = J.due_summaries(m).writeStream.format("parquet").option("path", out + "/due").option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("chatId string, messages long, tokens long").parquet(out + "/due")


def event_windows(spark, d):
    return J.windowed_counts(load(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, d):
    return J.sessions(load(spark, d, "events")).groupBy("n").agg(F.count(F.lit(1)).alias("sessions"))


QUERIES = {f.__name__: f for f in (audit_append_stream, publish_foreachbatch, debounce_state, event_windows, event_sessions)}
SQL = {
    "audit_append_stream": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "publish_foreachbatch": "SELECT count(DISTINCT chunkId) AS chunks, count(DISTINCT docName) AS docs FROM chunks",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2",
    "event_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1,2) SELECT n, count(*) AS sessions FROM c GROUP BY 1",
}
