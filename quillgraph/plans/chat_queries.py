"""Chat, memory, citation and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chat as C
from quillgraph.sources.tables import load


def _messages(spark, d):
    """One row per message id, the earliest."""
    m = load(spark, d, "messages").where("id is not null")
    return m.groupBy("id").agg(F.min(F.struct(F.col("createdAt").isNull().alias("n"), "createdAt", "chatId", "role", "content", "tokenCount")).alias("v")).select("id", "v.createdAt", "v.chatId", "v.role", "v.content", "v.tokenCount")


def recent_messages(spark, d):
    return C.recent_messages(_messages(spark, d), 4).select("chatId", "pos", "id")


def _marks(spark, d):
    m = _messages(spark, d).where("createdAt is not null and chatId is not null")
    r = C.recent_messages(m, 3).where("pos = 1").select("chatId", "id")
    return r.select("chatId", F.when(F.substring("chatId", 1, 1) < "4", F.col("id")).when(F.substring("chatId", 1, 1) < "8", F.lit("no-such-id")).alias("sinceId"))


def messages_since(spark, d):
    return C.messages_since(_messages(spark, d), _marks(spark, d)).select("chatId", "id")


def summariser_trigger(spark, d):
    return C.summary_due(C.messages_since(_messages(spark, d), _marks(spark, d)))


def message_paging(spark, d):
    m = _messages(spark, d).where("createdAt is not null")
    return C.page(m, [F.desc("createdAt"), F.asc("id")], 25, 50).select("id", "createdAt")


def chat_summaries(spark, d):
    return C.chat_summaries(_messages(spark, d))


def _statements(spark, d):
    """User messages; a hash share of them carries a statement to remember."""
    m = _messages(spark, d).join(load(spark, d, "chats").groupBy(F.col("id").alias("chatId")).agg(F.min("userId").alias("userId")), "chatId")
    said = F.element_at(F.array(*[F.lit(x) for x in ("please always answer in Arabic", "I prefer concise answers", "my role is Compliance Analyst.", "always include page numbers", "never mention internal codenames", "always answer in English. my account is 1234567890123")]), F.pmod(F.length("content"), F.lit(6)) + 1)
    return m.where("lower(trim(role)) = 'user' and createdAt is not null and content is not null").withColumn("content", F.when(F.pmod(F.length("content"), F.lit(4)) == 0, F.concat("content", F.lit(" "), said)).otherwise(F.col("content")))


def promoter_state(spark, d):
    p = C.promoted(C.promotions(_statements(spark, d)))
    return p.select("userId", "category", "key", "value", "source", F.round("confidence", 4).alias("confidence"))


def pii_gate(spark, d):
    return _statements(spark, d).groupBy(X.has_pii(F.col("content")).alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


def prompt_memory(spark, d):
    p = C.promoted(C.promotions(_statements(spark, d))).withColumn("updatedAt", F.lit(0))
    return C.prompt_memory(p, 2).select("userId", "rn", "category", "key", F.round("confidence", 4).alias("confidence"))


def prompt_budget(spark, d):
    m = load(spark, d, "chunks").dropDuplicates(["chunkId"]).select("chunkId", "text")
    p = C.assembled(F.lit("- [preference] language: Arabic"), F.lit(""), F.col("text"), F.col("text"), F.lit(None).cast("string"), F.col("chunkId"), F.lit("SYSTEM"))
    return m.select("chunkId", X.count_tokens(p).alias("words"), F.startswith(p, F.lit("SYSTEM\n\n- [preference]")).alias("ordered"), F.endswith(p, F.col("chunkId")).alias("last"))


def overflow_ladder(spark, d):
    v = load(spark, d, "v2_chunks").where("token_estimate is not null")
    t = F.col("token_estimate")
    return v.groupBy(C.overflow_steps(t, F.lit(120), F.lit(40), t * 2, 900).alias("step")).agg(F.count(F.lit(1)).alias("n"))


def citation_rank(spark, d):
    c = load(spark, d, "message_citations").where("chunkId is not null and score is not null").distinct()
    lists = c.groupBy("messageId").agg(F.expr("transform(array_sort(collect_list(struct(-score as s, id, chunkId))), x -> struct(x.chunkId as chunkId, -x.s as score, x.id as id))").alias("citations"))
    return C.ranked_citations(lists).select("messageId", F.col("rank").cast("int").alias("rank"), "id")


def citation_resolve(spark, d):
    c = load(spark, d, "message_citations").where("chunkId is not null")
    return C.resolved_citations(_messages(spark, d), c)


def cascade_delete(spark, d):
    users = load(spark, d, "chats").select(F.col("userId").alias("id")).where("id is not null").distinct()
    gone = users.where(F.substring("id", 1, 1) == "a")
    t = C.cascade_delete(users, load(spark, d, "chats"), load(spark, d, "messages"), load(spark, d, "message_citations"), load(spark, d, "audit_logs"), gone)
    counts = [t[k].agg(F.count(F.lit(1)).alias(k)) for k in ("users", "chats", "messages", "citations")] + [t["audit"].agg(F.count("userId").alias("audit_named"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out


def audit_actions(spark, d):
    a = load(spark, d, "audit_logs").distinct()
    return a.groupBy(F.lower("action").alias("action"), "entityType", F.date_format("createdAt", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("userId").alias("users"))


def session_lookup(spark, d):
    users = load(spark, d, "chats").select(F.col("userId").alias("id")).where("id is not null").distinct()
    sessions = users.select(F.col("id").alias("userId"), F.sha2(F.concat(F.lit("t-"), F.substring("id", 1, 2)), 256).alias("tokenHash"))
    return C.session_users(users, sessions, "t-2f")


_M = "mm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (createdAt IS NULL), createdAt, chatId NULLS FIRST, role NULLS FIRST, content NULLS FIRST) AS r FROM messages WHERE id IS NOT NULL) WHERE r=1), dm AS (SELECT * FROM mm WHERE createdAt IS NOT NULL AND chatId IS NOT NULL)"
_REC = "rk AS (SELECT *, row_number() OVER (PARTITION BY chatId ORDER BY createdAt DESC, id DESC) AS back, count(*) OVER (PARTITION BY chatId) AS n FROM dm)"
_MARK = _M + ", " + _REC + ", mk AS (SELECT chatId, CASE WHEN chatId[1]<'4' THEN id WHEN chatId[1]<'8' THEN 'no-such-id' END AS sinceId FROM rk WHERE back=least(n,3)), att AS (SELECT mk.chatId, mk.sinceId, dm.createdAt AS ca, dm.id AS ci FROM mk LEFT JOIN dm ON dm.chatId=mk.chatId AND dm.id=mk.sinceId), fr AS (SELECT dm.* FROM dm JOIN att USING (chatId) WHERE sinceId IS NULL OR dm.createdAt>ca OR (dm.createdAt=ca AND dm.id>ci))"
_TOKENS = "CASE WHEN regexp_replace(coalesce({0},''),'^\\s+|\\s+$','','g')='' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({0},'^\\s+|\\s+$','','g'),'\\s+')) END"
_SAID = "(['please always answer in Arabic','I prefer concise answers','my role is Compliance Analyst.','always include page numbers','never mention internal codenames','always answer in English. my account is 1234567890123'])[length(content)%6+1]"
_STM = _M + f", us AS (SELECT id AS chatId, min(userId) AS userId FROM chats GROUP BY 1), stm AS (SELECT mm.id, mm.chatId, us.userId, createdAt, CASE WHEN length(content)%4=0 THEN content||' '||{_SAID} ELSE content END AS content FROM mm JOIN us USING (chatId) WHERE lower(trim(role))='user' AND createdAt IS NOT NULL AND content IS NOT NULL)"
_PAT = " UNION ALL ".join("SELECT *, '{c}' AS category, '{k}' AS key, {i} AS pos, trim(regexp_extract(content,'{p}',1)) AS value FROM stm WHERE regexp_matches(content,'{p}') AND NOT regexp_matches(content,'\\b[0-9]{{10,}}\\b')".format(c=c, k=k, i=i, p=p.replace("'", "''")) for i, (p, c, k) in enumerate(C.PROMOTIONS))
_PROM = _STM + f", pm AS ({_PAT}), pr AS (SELECT userId, category, key, arg_max(value, struct_pack(a:=createdAt,b:=id,c:=pos)) AS value, least(0.95, 0.7+0.05*(count(*)-1)) AS confidence FROM pm GROUP BY 1,2,3)"

QUERIES = {
    f.__name__: f
    for f in (
        recent_messages, messages_since, summariser_trigger, message_paging, chat_summaries, promoter_state, pii_gate, prompt_memory, prompt_budget, overflow_ladder, citation_rank, citation_resolve, cascade_delete, audit_actions, session_lookup,
    )
}
SQL = {
    "recent_messages": f"WITH {_M}, {_REC} SELECT chatId, (least(n,4)-back+1)::INT AS pos, id FROM rk WHERE back<=4",
    "messages_since": f"WITH {_MARK} SELECT chatId, id FROM fr",
    "summariser_trigger": f"WITH {_MARK} SELECT chatId, count(*) AS messages, sum({_TOKENS.format('content')})::BIGINT AS tokens, (count(*)>=6 OR sum({_TOKENS.format('content')})>=1000) AS due FROM fr GROUP BY 1",
    "message_paging": f"WITH {_M} SELECT id, createdAt FROM mm WHERE createdAt IS NOT NULL ORDER BY createdAt DESC, id LIMIT 25 OFFSET 50",
    "chat_summaries": f"WITH {_M} SELECT chatId, count(*) AS messages, max(createdAt) AS updatedAt, substr(arg_min(content, struct_pack(a:=createdAt,b:=id)) FILTER (WHERE lower(trim(role)) IN ('user','human') AND createdAt IS NOT NULL AND content IS NOT NULL),1,60) AS title FROM mm WHERE chatId IS NOT NULL GROUP BY 1",
    "promoter_state": f"WITH {_PROM} SELECT userId, category, key, value, 'inferred' AS source, round(confidence,4)::DOUBLE AS confidence FROM pr",
    "pii_gate": f"WITH {_STM} SELECT regexp_matches(content,'\\b[0-9]{{10,}}\\b') AS blocked, count(*) AS n FROM stm GROUP BY 1",
    "prompt_memory": f"WITH {_PROM}, r AS (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY confidence DESC, key) AS rn FROM pr WHERE category IN ('preference','instruction')) SELECT userId, rn::INT AS rn, category, key, round(confidence,4)::DOUBLE AS confidence FROM r WHERE rn<=2",
    "prompt_budget": f"WITH c AS (SELECT DISTINCT ON (chunkId) chunkId, text, {_TOKENS.format('text')} AS n FROM chunks) SELECT chunkId, (1+4+least(n,600)+least(n,20000)+{_TOKENS.format('chunkId')})::INT AS words, true AS ordered, true AS last FROM c",
    "overflow_ladder": "WITH t AS (SELECT token_estimate AS t, 120 AS s, 40 AS m, token_estimate*2 AS c FROM v2_chunks WHERE token_estimate IS NOT NULL) SELECT CASE WHEN t+s+m+c<=900 THEN 'fits' WHEN s+m+c<=900 THEN 'drop_turns' WHEN m+c<=900 THEN 'shorten_summary' WHEN c<=900 THEN 'drop_memory' ELSE 'drop_chunk' END AS step, count(*) AS n FROM t GROUP BY 1",
    "citation_rank": "WITH c AS (SELECT DISTINCT * FROM message_citations WHERE chunkId IS NOT NULL AND score IS NOT NULL) SELECT messageId, row_number() OVER (PARTITION BY messageId ORDER BY -score, id, chunkId)::INT AS rank, id FROM c",
    "citation_resolve": f"WITH {_M}, k AS (SELECT DISTINCT id, unnest(regexp_extract_all(content,'\\[([^\\[\\]]+)\\]',1)) AS chunkId FROM mm WHERE contains(content,'[')) SELECT k.id, k.chunkId, min(c.rank) AS number FROM k JOIN message_citations c ON c.messageId=k.id AND c.chunkId=k.chunkId GROUP BY 1,2",
    "cascade_delete": "WITH u AS (SELECT DISTINCT userId AS id FROM chats WHERE userId IS NOT NULL), dc AS (SELECT DISTINCT id FROM chats WHERE userId[1]='a'), dm AS (SELECT DISTINCT id FROM messages WHERE chatId IN (SELECT id FROM dc)) SELECT (SELECT count(*) FROM u WHERE id[1]<>'a') AS users, (SELECT count(*) FROM chats WHERE userId IS NULL OR userId[1]<>'a') AS chats, (SELECT count(*) FROM messages m WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.id=m.chatId)) AS messages, (SELECT count(*) FROM message_citations c WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.id=c.messageId)) AS citations, (SELECT count(*) FROM audit_logs a WHERE a.userId IS NOT NULL AND NOT (a.userId[1]='a' AND a.userId IN (SELECT id FROM u))) AS audit_named",
    "audit_actions": "SELECT lower(action) AS action, entityType, strftime(createdAt AT TIME ZONE 'UTC','%Y-%m') AS month, count(*) AS n, count(DISTINCT userId) AS users FROM (SELECT DISTINCT * FROM audit_logs) GROUP BY 1,2,3",
    "session_lookup": "SELECT DISTINCT userId AS id FROM chats WHERE substr(userId,1,2)='2f'",
}
