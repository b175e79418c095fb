"""Chat, memory and audit operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.functions import text as X

# Patterns of statements worth remembering, in order: (pattern, category, key).
PROMOTIONS = [
    (r"(?i)always answer in (\w+)", "preference", "language"),
    (r"(?i)answer in (arabic|english|french|spanish)", "preference", "language"),
    (r"(?i)prefer (concise|detailed|brief|verbose) answers?", "preference", "verbosity"),
    (r"(?i)my (?:role|division|department) is ([^.\n]+)", "profile", "role"),
    (r"(?i)always include (page numbers|article numbers|citations|sources)", "instruction", "always_include"),
    (r"(?i)never (mention|include|cite) ([^.\n]+)", "instruction", "never_include"),
]
# Token budgets of a prompt's parts; when a chat is due for a summary; confidences.
BUDGETS = {"memory": 80, "summary": 300, "history": 600, "context": 20000, "question": 500}
DUE_MESSAGES, DUE_TOKENS = 6, 1000
NEW_CONFIDENCE, STEP, MOST = 0.7, 0.05, 0.95


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY, LIMIT, OFFSET; give a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` dated messages of each chat with ``pos`` 1..n, oldest first."""
    w = W.Window.partitionBy("chatId").orderBy(F.desc("createdAt"), F.desc("id"))
    last = messages.where("createdAt is not null and chatId is not null").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.withColumn("pos", F.row_number().over(W.Window.partitionBy("chatId").orderBy(F.desc("back")))).drop("back")


def messages_since(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages strictly after each chat's mark ``chatId, sinceId``: all where the mark is null, none where it is unknown."""
    m = messages.where("createdAt is not null and chatId is not null")
    at = marks.join(m.select(F.col("chatId"), F.col("id").alias("sinceId"), F.struct("createdAt", "id").alias("at")), ["chatId", "sinceId"], "left")
    known = m.join(at, "chatId")
    return known.where(F.col("sinceId").isNull() | (F.struct("createdAt", "id") > F.col("at"))).drop("sinceId", "at")


def summary_due(fresh: DataFrame) -> DataFrame:
    """Per chat: new messages, their words, and whether a summary is due."""
    g = fresh.groupBy("chatId").agg(F.count(F.lit(1)).alias("messages"), F.sum(X.count_tokens(F.col("content"))).alias("tokens"))
    return g.withColumn("due", (F.col("messages") >= DUE_MESSAGES) | (F.col("tokens") >= DUE_TOKENS))


def promotions(messages: DataFrame) -> DataFrame:
    """``userId, chatId, id, createdAt, category, key, value, pos`` from messages that hold no long number."""
    c = F.col("content")
    found = F.array_compact(F.array(*[F.when(c.rlike(p), F.struct(F.lit(cat).alias("category"), F.lit(k).alias("key"), F.trim(F.regexp_extract(c, p, 1)).alias("value"), F.lit(i).alias("pos"))) for i, (p, cat, k) in enumerate(PROMOTIONS)]))
    return messages.where(c.isNotNull() & ~X.has_pii(c)).select("userId", "chatId", "id", "createdAt", F.explode(found).alias("f")).select("userId", "chatId", "id", "createdAt", "f.*")


def promoted(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """User memory after all promotions: the last value, 0.7 plus 0.05 per repeat up to 0.95; explicit rows stay.

    ``existing`` has ``userId, category, key, value, source, confidence``. The
    confidence after n repeats has a closed form, so nothing is folded row by
    row.
    """
    last = F.max(F.struct("createdAt", "id", "pos", "value", "chatId"))
    g = found.groupBy("userId", "category", "key").agg(F.count(F.lit(1)).alias("n"), last.alias("l"))
    if existing is None:
        existing = g.limit(0).select("userId", "category", "key", F.lit("").alias("value"), F.lit("").alias("source"), F.lit(0.0).alias("confidence"))
    e = existing.select("userId", "category", "key", F.col("value").alias("ev"), F.col("source").alias("es"), F.col("confidence").alias("ec"))
    j = g.join(e, ["userId", "category", "key"], "full")
    explicit = F.col("es") == "explicit"
    grown = F.when(F.col("es").isNull(), F.least(F.lit(MOST), NEW_CONFIDENCE + STEP * (F.col("n") - 1))).otherwise(F.least(F.lit(MOST), F.col("ec") + STEP * F.col("n")))
    keep = F.coalesce(explicit, F.lit(False)) | F.col("n").isNull()
    return j.select(
        "userId", "category", "key", F.when(keep, F.col("ev")).otherwise(F.col("l.value")).alias("value"), F.when(keep, F.col("es")).when(F.col("es").isNull(), "inferred").otherwise(F.col("es")).alias("source"),
        F.when(keep, F.col("ec")).otherwise(grown).alias("confidence"),
    )


def prompt_memory(memory: DataFrame, most: int = 5) -> DataFrame:
    """Preferences and instructions only, the most confident first, then the latest."""
    w = W.Window.partitionBy("userId").orderBy(F.desc("confidence"), F.desc("updatedAt"), "key")
    return memory.where("category in ('preference', 'instruction')").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def assembled(memory: Column, summary: Column, history: Column, context: Column, reminder: Column, question: Column, system: Column) -> Column:
    """The prompt: system, memory, summary, history, context, reminder, question last; parts cut to their budgets, empty ones left out."""
    cut = lambda c, k: X.truncate_tokens(c, BUDGETS[k])
    parts = F.array(system, cut(memory, "memory"), cut(summary, "summary"), cut(history, "history"), cut(context, "context"), reminder, cut(question, "question"))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")


def overflow_steps(turns: Column, summary: Column, memory: Column, chunks: Column, budget: int) -> Column:
    """What gives way when token counts exceed a budget: oldest turns, summary, memory, chunks, in this order."""
    total = turns + summary + memory + chunks
    return F.when(total <= budget, "fits").when(summary + memory + chunks <= budget, "drop_turns").when(memory + chunks <= budget, "shorten_summary").when(chunks <= budget, "drop_memory").otherwise("drop_chunk")


def ranked_citations(lists: DataFrame, key: str = "messageId", items: str = "citations") -> DataFrame:
    """Cited items with their 1-based rank."""
    return lists.select(key, F.posexplode(items).alias("p", "c")).select(key, (F.col("p") + 1).alias("rank"), "c.*")


def resolved_citations(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """``id, chunkId, number``: the ``[chunkId]`` marks of an answer that are among its citations, numbered by rank."""
    marks = messages.where(F.contains("content", F.lit("["))).select("id", F.explode_outer(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))).alias("chunkId")).where("chunkId is not null")
    c = citations.groupBy(F.col("messageId").alias("id"), "chunkId").agg(F.min("rank").alias("number"))
    return marks.distinct().join(c, ["id", "chunkId"])


def chat_summaries(messages: DataFrame) -> DataFrame:
    """Per chat the first 60 characters of its first user message, its size and last activity."""
    m = messages.where("chatId is not null")
    first = F.min_by("content", F.struct("createdAt", "id"))
    users = m.where("lower(trim(role)) in ('user', 'human') and createdAt is not null").groupBy("chatId").agg(F.substring(first, 1, 60).alias("title"))
    return m.groupBy("chatId").agg(F.count(F.lit(1)).alias("messages"), F.max("createdAt").alias("updatedAt")).join(users, "chatId", "left")


def cascade_delete(users: DataFrame, chats: DataFrame, messages: DataFrame, citations: DataFrame, audit: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the users of ``gone``: their chats, messages and citations go, log rows lose the name."""
    g = gone.select(F.col("id").alias("_g")).distinct()
    chats_left = chats.join(g, F.col("userId") == F.col("_g"), "left_anti")
    dead_chats = chats.join(g, F.col("userId") == F.col("_g"), "left_semi").select(F.col("id").alias("_c")).distinct()
    dead_messages = messages.join(dead_chats, F.col("chatId") == F.col("_c"), "left_semi").select(F.col("id").alias("_m")).distinct()
    named = audit.join(g, F.col("userId") == F.col("_g"), "left").withColumn("userId", F.when(F.col("_g").isNull(), F.col("userId"))).drop("_g")
    return {
        "users": users.join(g, F.col("id") == F.col("_g"), "left_anti"), "chats": chats_left, "messages": messages.join(dead_chats, F.col("chatId") == F.col("_c"), "left_anti"),
        "citations": citations.join(dead_messages, F.col("messageId") == F.col("_m"), "left_anti"), "audit": named,
    }


def session_users(users: DataFrame, sessions: DataFrame, token: str) -> DataFrame:
    """The user of a session token, looked up by the token's hash."""
    ids = sessions.where(F.col("tokenHash") == F.sha2(F.lit(token), 256)).select(F.col("userId").alias("_u")).distinct()
    return users.join(ids, F.col("id") == F.col("_u"), "left_semi")
