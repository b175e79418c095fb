"""Vector, full-text and fused retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import fulltext as T
from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.operators import vector as V
from quillgraph.sources.tables import load

#: Tiers that suit these vectors, whose nearest neighbours have cosines around .4.
TIERS = (0.30, 0.35, 0.40, 0.45)
QUERY_ID, WORDS = 7, ["liquidity", "buffers", "operational", "resilience", "الائتمان"]


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("type"))


def _query(spark, d):
    return _vectors(spark, d).where(F.col("id") == QUERY_ID)


def _centroids(spark, d):
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return c.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(i, m))), x -> x.m)").alias("vector")).select(F.col("label").alias("id"), "vector")


def _allowed(spark, d):
    return load(spark, d, "embeddings").where("label in (1, 3, 5, 7)").select(F.col("label").alias("type"))


def vector_topk(spark, d):
    return V.vector_search(_vectors(spark, d), _query(spark, d), 20).select("id", F.round("score", 6).alias("score"))


def vector_topk_all(spark, d):
    v = _vectors(spark, d)
    return V.search_all(v.where("id % 100 = 0"), v, 20).select("query", "id", F.round("score", 6).alias("score"))


def vector_topk_rbac(spark, d):
    return V.vector_search(_vectors(spark, d), _query(spark, d), 10, _allowed(spark, d)).select("id", "type", F.round("score", 6).alias("score"))


def vector_overfetch_compat(spark, d):
    return V.overfetch_search(_vectors(spark, d), _query(spark, d), 10, _allowed(spark, d)).select("id", "type", F.round("score", 6).alias("score"))


def reltype_selection(spark, d):
    return V.relation_selection(_centroids(spark, d), _query(spark, d)).select("id", F.round("score", 6).alias("score"))


def seed_masses(spark, d):
    return V.seed_masses(_vectors(spark, d), _query(spark, d)).select("id", F.round("mass", 6).alias("mass"))


def synonym_pairs(spark, d):
    return V.similar_pairs(_vectors(spark, d), 0.35).select("a", "b", F.round("score", 6).alias("score"))


def nearest_entity(spark, d):
    v = _vectors(spark, d)
    return V.nearest(v.where("id % 100 = 0"), v).select("id", "near", F.round("score", 6).alias("score"))


def similarity_tiers(spark, d):
    v = _vectors(spark, d)
    n = V.nearest(v.where("id % 100 = 0"), v)
    t = n.groupBy(V.tier(F.col("score"), TIERS).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return t.crossJoin(t.agg(F.sum("n").alias("all"))).select("tier", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent"))


def bm25_topk(spark, d):
    return T.bm25(load(spark, d, "documents"), "doc_id", "text", WORDS).orderBy(F.desc(F.round("score", 6)), "key").limit(25).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def inverted_index(spark, d):
    p = T.postings(load(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def hybrid_rrf(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id"), "text")
    v = V.vector_search(_vectors(spark, d), _query(spark, d), 20).select("id", F.round("score", 6).alias("score"))
    f = T.bm25(docs, "doc_id", "text", WORDS).select(F.col("key").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return R.rrf([R.ranked(v), R.ranked(f)], 10).select("id", F.round("score", 9).alias("score"))


def clearance_matrix(spark, d):
    c = load(spark, d, "chunks").select(F.explode(F.array(*[F.lit(x) for x in R.LEVELS])).alias("clearance"), R.level_rank(F.col("accessLevel")).alias("need"), F.expr("docName"))
    need = F.array_position(F.array(*[F.lit(x) for x in R.LEVELS]), F.col("clearance"))
    return c.where(F.col("need") <= need).groupBy("clearance").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("docName").alias("docs"))


def _trails(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")).distinct()
    return m, G.comention_edges(m).select(F.struct("src", "dst").alias("edge_id"), "src", "dst", "weight")


def khop_retrieval(spark, d):
    m, e = _trails(spark, d)
    return R.khop_chunks(e, m, _vectors(spark, d), _query(spark, d), seeds=8, depth=2, top=20).select("chunk", F.round("score", 6).alias("score"))


def path_scores_chunk_max(spark, d):
    m, e = _trails(spark, d)
    paths = G.trail_paths(e, load(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node")), 2).withColumn("path_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"))
    s = R.path_scores(paths.select("path_id", "nodes").distinct(), V.scored(_vectors(spark, d), _query(spark, d)))
    return R.chunks_of_paths(s, m).select("chunk", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q = f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id={QUERY_ID}), s AS (SELECT vec_id AS id, label AS type, {_COS} AS score FROM embeddings a, q)"
_TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text,'')), '[^\\p{L}\\p{N}_]+'), lambda x: x<>'')"
_BM = (
    f"t AS (SELECT doc_id AS key, {_TERMS} AS t FROM documents), l AS (SELECT key, t, len(t) AS len FROM t), st AS (SELECT count(*) AS n, avg(len) AS avglen FROM l), "
    f"x AS (SELECT key, len, unnest(t) AS term FROM l), tf AS (SELECT key, len, term, count(*) AS tf FROM x WHERE term IN ({','.join(repr(w) for w in WORDS)}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    "bm AS (SELECT key, sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len/avglen))) AS score FROM tf JOIN df USING (term), st GROUP BY 1)"
)
_RANK = "CASE lower(trim(coalesce(accessLevel,'internal'))) WHEN 'public' THEN 1 WHEN 'internal' THEN 2 WHEN 'confidential' THEN 3 WHEN 'restricted' THEN 4 ELSE 2 END"
_TRAIL = (
    "pm AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS entity FROM lineitem), st AS (SELECT a.entity||'-'||b.entity AS edge_id, a.entity AS src, b.entity AS dst FROM pm a JOIN pm b ON a.chunk=b.chunk AND a.entity<b.entity GROUP BY ALL), "
    "step AS (SELECT edge_id, src AS node, dst AS nxt FROM st UNION ALL SELECT edge_id, dst, src FROM st), p1 AS (SELECT nxt AS target, [node,nxt] AS nodes, [edge_id] AS es FROM step WHERE node IN (SELECT node FROM seeds)), "
    "p2 AS (SELECT s.nxt AS target, list_append(nodes,s.nxt) AS nodes, list_append(es,edge_id) AS es FROM p1 JOIN step s ON p1.target=s.node WHERE NOT list_contains(es,edge_id)), p AS (SELECT DISTINCT nodes FROM p1 UNION SELECT nodes FROM p2), "
    "pn AS (SELECT nodes, unnest(nodes) AS id FROM p), ps AS (SELECT nodes, avg(score) AS score FROM pn JOIN s USING (id) GROUP BY 1), pc AS (SELECT DISTINCT pn.nodes, chunk FROM pn JOIN pm ON pn.id=pm.entity), r AS (SELECT chunk, round(max(score),6) AS score, max(score) AS raw FROM ps JOIN pc USING (nodes) WHERE score>0 GROUP BY 1)"
)

QUERIES = {
    f.__name__: f
    for f in (vector_topk, vector_topk_all, vector_topk_rbac, vector_overfetch_compat, reltype_selection, seed_masses, synonym_pairs, nearest_entity, similarity_tiers, bm25_topk, inverted_index, hybrid_rrf, clearance_matrix, khop_retrieval, path_scores_chunk_max)
}
_NEAR = "n AS (SELECT a.vec_id AS id, b.vec_id AS near, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id%100=0 AND b.vec_id<>a.vec_id)"
SQL = {
    "vector_topk": f"{_Q} SELECT id, round(score,6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20",
    "vector_topk_all": "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rn FROM embeddings q, embeddings e WHERE q.vec_id%100=0 AND q.vec_id<>e.vec_id) SELECT query, id, round(score,6) AS score FROM s WHERE rn<=20",
    "vector_topk_rbac": f"{_Q} SELECT id, type, round(score,6) AS score FROM s WHERE type IN (1,3,5,7) ORDER BY s.score DESC, id LIMIT 10",
    "vector_overfetch_compat": f"{_Q}, p AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 40) SELECT id, type, round(score,6) AS score FROM p WHERE type IN (1,3,5,7) ORDER BY p.score DESC, id LIMIT 10",
    "reltype_selection": f"WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1,65) r(i) GROUP BY ALL) GROUP BY 1), s AS (SELECT label AS id, list_cosine_similarity(v, q.embedding::DOUBLE[]) AS score FROM c, (SELECT embedding FROM embeddings WHERE vec_id={QUERY_ID}) q), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) SELECT id, round(score,6) AS score FROM r WHERE (score>=0.25 AND rank<=5) OR rank=1",
    "seed_masses": f"{_Q}, t AS (SELECT id, greatest(score,0) AS g FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 5)) SELECT id, round(g/(SELECT sum(g) FROM t),6) AS mass FROM t",
    "synonym_pairs": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS score FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])>=0.35",
    "nearest_entity": f"WITH {_NEAR} SELECT id, near, round(score,6) AS score FROM n WHERE rn=1",
    "similarity_tiers": f"WITH {_NEAR}, t AS (SELECT CASE WHEN score>=0.45 THEN '0.45+' WHEN score>=0.4 THEN '0.40-0.45' WHEN score>=0.35 THEN '0.35-0.40' WHEN score>=0.3 THEN '0.30-0.35' ELSE '<0.30' END AS tier FROM n WHERE rn=1) SELECT tier, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM t),4) AS percent FROM t GROUP BY 1",
    "bm25_topk": f"WITH {_BM} SELECT key AS doc_id, round(score,6) AS score FROM bm ORDER BY round(bm.score,6) DESC, key LIMIT 25",
    "inverted_index": f"WITH x AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1",
    "hybrid_rrf": f"{_Q}, {_BM}, v AS (SELECT id, row_number() OVER (ORDER BY round(score,6) DESC, id)-1 AS rank, 0 AS l FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 20)), f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)-1 AS rank, 1 AS l FROM (SELECT key AS id, round(score,6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 20)), u AS (SELECT * FROM v UNION ALL SELECT * FROM f) SELECT id, round(sum(1.0/(61+rank)),9) AS score FROM u GROUP BY id ORDER BY sum(1.0/(61+rank)) DESC, min(l*1000+rank) LIMIT 10",
    "clearance_matrix": f"SELECT c.clearance, count(*) AS chunks, count(DISTINCT docName) AS docs FROM chunks, (VALUES ('public',1),('internal',2),('confidential',3),('restricted',4)) c(clearance,r) WHERE {_RANK}<=c.r GROUP BY 1",
    "khop_retrieval": f"{_Q}, seeds AS (SELECT id AS node FROM s ORDER BY score DESC, id LIMIT 8), {_TRAIL} SELECT chunk, score FROM r ORDER BY raw DESC, chunk LIMIT 20",
    "path_scores_chunk_max": f"{_Q}, seeds AS (SELECT p_partkey AS node FROM part WHERE p_partkey%100=0), {_TRAIL} SELECT chunk, score FROM r",
}
