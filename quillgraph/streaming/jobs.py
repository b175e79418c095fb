"""Structured Streaming jobs: publishing, audit, debounced summaries, promotions and event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions import text as X
from quillgraph.operators import chat as C
from quillgraph.sources.writers import latest, merge_into, recover


def files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)


def publish(stream: DataFrame, path: str, keys: list[str], checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, version: str | None = None, partition: str | None = None) -> StreamingQuery:
    """Upserts every micro-batch by key (a repeated batch changes nothing) and runs the post-pass where it held rows.

    Of a key's rows in one batch the one with the greatest ``version`` counts; with ``partition`` only the partitions touched are rewritten.
    """

    def each(batch: DataFrame, n: int) -> None:
        rows = latest(batch, keys, version)
        if rows.isEmpty():
            return
        merge_into(rows, path, keys, partition=partition)
        if after:
            after(rows, n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events per type and window; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Bursts of a user's events."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def due_summaries(messages: DataFrame, due_messages: int = C.DUE_MESSAGES, due_tokens: int = C.DUE_TOKENS) -> DataFrame:
    """``chatId, messages, tokens`` whenever a chat has gathered enough since its last summary.

    The state per chat is two numbers; emitting resets them (the debounce).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, t = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            t += int(b["tokens"].sum())
        if n >= due_messages or t >= due_tokens:
            state.update((0, 0))
            yield pd.DataFrame({"chatId": [key[0]], "messages": [n], "tokens": [t]})
        else:
            state.update((n, t))

    m = messages.where("chatId is not null").select("chatId", X.count_tokens(F.col("content")).alias("tokens"))
    return m.groupBy("chatId").applyInPandasWithState(step, "chatId string, messages long, tokens long", "messages long, tokens long", "append", GroupStateTimeout.NoTimeout)


def promote(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Promotions of each micro-batch merged into the user memory under ``path``; explicit rows stay as they are."""

    def each(batch: DataFrame, n: int) -> None:
        found = C.promotions(batch)
        if found.isEmpty():
            return
        spark = batch.sparkSession
        known = spark.read.parquet(path) if recover(spark, path) else None
        merge_into(C.promoted(found, known), path, ["userId", "category", "key"])

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_events(answers: DataFrame) -> DataFrame:
    """``id, seq, type, payload``: an answer as the rows of an event stream, citations first, then words, then done."""
    w = F.transform(F.filter(F.split("content", " "), lambda x: x != ""), lambda x: F.struct(F.lit("token").alias("type"), x.alias("payload")))
    cites = F.struct(F.lit("citations").alias("type"), F.to_json("citations").alias("payload"))
    done = F.struct(F.lit("done").alias("type"), F.lit("").alias("payload"))
    e = answers.select("id", F.posexplode(F.concat(F.array(cites), w, F.array(done))).alias("seq", "e"))
    return e.select("id", "seq", "e.type", "e.payload")


def event_frames(events: DataFrame):
    """The wire form ``data: {...}`` of event rows."""
    return events.select("id", "seq", F.concat(F.lit("data: "), F.to_json(F.struct("type", "payload")), F.lit("\n\n")).alias("frame"))


def parsed_frames(frames: DataFrame) -> DataFrame:
    """Event rows back from their wire form."""
    j = F.from_json(F.regexp_replace(F.regexp_replace("frame", r"^data: ", ""), r"\n\n$", ""), "type string, payload string")
    return frames.select("id", "seq", j.alias("e")).select("id", "seq", "e.type", "e.payload")
