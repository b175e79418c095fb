"""What the web layer asks of the tables: chats, memories, sessions, projections and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.entities import upsert

#: Length of a chat's title, taken from its first question.
TITLE = 60
# Defaults of a retrieval request.
REQUEST = {"mode": "vector", "k": 5, "hops": 1}


def title_of(question: Column) -> Column:
    return F.substring(F.trim(question), 1, TITLE)


def create_chats(chats: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """``chats`` with a row for every new one of ``asked`` (``id, userId, question``); ids that exist stay as they are."""
    new = asked.select("id", "userId", title_of(F.col("question")).alias("title"), now.alias("createdAt"), now.alias("updatedAt"))
    return upsert(chats.select("id", "userId", "title", "createdAt", "updatedAt"), new, ["id"], prefer_new=False)


def owned(chats: DataFrame, users: DataFrame) -> DataFrame:
    """Chats of the given users (``userId``), a repeated row once: the owner scope of every request."""
    return chats.join(users.select("userId").distinct(), "userId", "left_semi").distinct()


def listed(chats: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of chats, the last active first."""
    return chats.orderBy(F.desc_nulls_last("updatedAt"), "id").offset(offset).limit(limit)


def renamed(chats: DataFrame, titles: DataFrame) -> DataFrame:
    """Chats with the titles of ``titles`` (``id, title``) where those are not blank."""
    t = titles.where("trim(title) != ''").groupBy("id").agg(F.min("title").alias("_t"))
    return chats.join(t, "id", "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def deleted(chats: DataFrame, messages: DataFrame, citations: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The three tables without the chats of ``ids`` (``id``), their messages and those messages' citations."""
    gone = ids.select(F.col("id").alias("_c")).distinct()
    dead = messages.join(gone, F.col("chatId") == F.col("_c"), "left_semi").select(F.col("id").alias("_m")).distinct()
    return {
        "chats": chats.join(gone, F.col("id") == F.col("_c"), "left_anti"), "messages": messages.join(gone, F.col("chatId") == F.col("_c"), "left_anti"),
        "citations": citations.join(dead, F.col("messageId") == F.col("_m"), "left_anti"),
    }


def remembered(memory: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Memory rows by key, the new ones in place of the old."""
    return upsert(memory, new.select(memory.columns), list(keys))


def logged_in(sessions: DataFrame, users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sessions with a row for each of ``tokens`` (``userId, token``) whose user exists; only the token's hash is kept."""
    new = tokens.join(users.select(F.col("id").alias("userId")).distinct(), "userId", "left_semi").select(F.sha2("token", 256).alias("tokenHash"), "userId")
    return upsert(sessions.select("tokenHash", "userId"), new, ["tokenHash"])


def logged_out(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    return sessions.join(tokens.select(F.sha2("token", 256).alias("tokenHash")), "tokenHash", "left_anti")


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as they leave the service: internal columns are dropped, equal rows stay."""
    return df.drop(*columns)


def stamps(df: DataFrame, *columns: str) -> DataFrame:
    """Times as ISO texts in UTC, null where there is none."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in columns})


def question_prompt(context: Column, question: Column) -> Column:
    """Context, then the question; without context the question alone."""
    return F.when(F.coalesce(F.trim(context), F.lit("")) == "", F.concat(F.lit("Question: "), question)).otherwise(F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question))


def summary_prompt(previous: Column, turns: Column) -> Column:
    """Previous summary (if any) and new turns ``role: content`` line by line."""
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    head = F.when(F.coalesce(F.trim(previous), F.lit("")) != "", F.concat(F.lit("Summary so far:\n"), previous, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("New messages:\n"), lines)


def discovered(extracted: DataFrame, chunked: DataFrame, key: str = "docName") -> DataFrame:
    """Documents that are both extracted and chunked."""
    return extracted.select(key).distinct().join(chunked.select(key).distinct(), key, "left_semi")
