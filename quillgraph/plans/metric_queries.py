"""Evaluation, community and annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillgraph.functions.vectors import cosine
from quillgraph.operators import align as A
from quillgraph.operators import community as CM
from quillgraph.operators import discovery as D
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import ner as N
from quillgraph.sources.tables import load


def _retrieved(spark, d):
    """Ten nearest vectors for every hundredth one; the same label is relevant, hop = label mod 3."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qe"), F.col("label").alias("ql"))
    s = q.join(e, F.col("query") != F.col("vec_id")).withColumn("score", cosine(F.col("embedding"), F.col("qe")))
    r = s.withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    top = r.where("rank <= 10").select("query", F.col("vec_id").alias("item"), "rank", (F.col("ql") % 3).alias("hop"))
    gold = s.where("ql = label").select("query", F.col("vec_id").alias("item"))
    return top, gold


def recall_precision_mrr(spark, d):
    t, g = _retrieved(spark, d)
    return M.ranking_metrics(t, g, 5).select("query", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "mrr")])


def recall_hit_by_hop(spark, d):
    t, g = _retrieved(spark, d)
    r = M.recall_hits(t, g)
    return r.select(F.coalesce(F.col("hop").cast("string"), F.lit("all")).alias("hop"), "queries", *[F.round(c, 9).alias(c) for c in r.columns if c.startswith(("recall", "hit"))])


def nmi_ari(spark, d):
    l = load(spark, d, "embeddings").select(F.col("label").alias("a"), F.when(F.col("vec_id") % 4 == 0, F.col("label") % 3).otherwise(F.col("label") % 5).alias("b"))
    return M.agreement(l).select(F.round("nmi", 9).alias("nmi"), F.round("ari", 9).alias("ari"))


def _adj(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("entity"))
    return G.adjacency(G.comention_edges(m))


def modularity(spark, d):
    labels = load(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("label"))
    return M.modularity(_adj(spark, d), labels).select(F.round("modularity", 9).alias("modularity"))


def plurality_parent(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("child"), (F.col("s_suppkey") % 4).alias("parent"))
    return M.plurality_parent(s)


def percentile_probe(spark, d):
    m = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    p = M.percentiles(m, "n")
    return p.select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max")


def rank_probe(spark, d):
    e = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return M.rank_above(e, "n").where("rank <= 40").select("o_custkey", "n", F.col("rank").cast("int").alias("rank"))


def mean_spread(spark, d):
    r = M.mean_spread(load(spark, d, "events"), "value", ["event_type"])
    return r.select("event_type", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


def json_fields(spark, d):
    e = load(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _spans(spark, d):
    return N.task_spans(load(spark, d, "ls_import"))


def span_prf(spark, d):
    s = _spans(spark, d).where("chunkId is not null")
    r = M.span_prf(s.where("type in ('Person', 'BankingInstitution')"), s.where("length(text) > 14"), ["chunkId", "start", "end"])
    return r.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def gazetteer_build(spark, d):
    s = _spans(spark, d).select("type", "text", F.col("id").alias("seq"), F.when(F.length("text") % 5 == 0, 0.5).otherwise(0.9).alias("score"))
    return N.gazetteer(s).select("type", F.array_join("surfaces", "|").alias("surfaces"))


def _tokens(spark, d):
    t = load(spark, d, "ls_import").select(F.col("meta.chunkId").alias("chunkId"), F.col("data.text").alias("text")).where("chunkId is not null").dropDuplicates(["chunkId"])
    return N.word_offsets(t.withColumn("w", F.split("text", " ")), "chunkId", "w")


def span_offsets(spark, d):
    return _tokens(spark, d).groupBy("chunkId").agg(F.count(F.lit(1)).alias("tokens"), F.max("end").alias("end"), F.sum("start").alias("starts"))


def bio_labels(spark, d):
    return N.bio_labels(_tokens(spark, d), _spans(spark, d).where("chunkId is not null"), "chunkId").groupBy("chunkId", "label").agg(F.count(F.lit(1)).alias("n"))


def bio_spans(spark, d):
    l = N.bio_labels(_tokens(spark, d), _spans(spark, d).where("chunkId is not null"), "chunkId")
    return N.bio_spans(l, "chunkId").select("chunkId", "start", "end", "text")


def annotation_roundtrip(spark, d):
    t = load(spark, d, "ls_import").select(F.col("meta.chunkId").alias("chunkId"), F.col("meta.docName").alias("docName"), F.col("data.text").alias("text")).where("chunkId is not null").dropDuplicates(["chunkId"])
    s = _spans(spark, d).where("chunkId is not null").select("chunkId", "id", "text", "type", "start", "end").distinct()
    back = N.task_spans(N.as_tasks(s, t))
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunkId").alias("chunks"))


def explorer_search(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    hit = p.where((F.lower("p_name").contains("green") | F.lower(F.col("p_partkey").cast("string")).contains("99")) & F.col("p_brand").isNotNull())
    n = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("chunks"))
    return hit.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.substring("p_name", 1, 40).alias("label"), F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy(F.desc("chunks"), "p_partkey").limit(30)


def explorer_type_counts(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("p_type").alias("types"))


def _entities(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("type"))
    n = load(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    return e.join(n, "id", "left").select("id", F.concat(F.lit("n "), (F.col("id") % 211).cast("string")).alias("name"), "type", "vector", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def alignment_components(spark, d):
    return A.clusters(A.duplicate_links(_entities(spark, d), 0.40))


def merge_cluster(spark, d):
    e = _entities(spark, d)
    return A.canonical_map(A.clusters(A.duplicate_links(e, 0.40)), e)


def leiden_hierarchy(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    adj = G.adjacency(G.comention_edges(m))
    return CM.long_hierarchy(CM.hierarchy(adj)).groupBy("level").agg(F.count_distinct("label").alias("communities"), F.count(F.lit(1)).alias("nodes"))


_E = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_R = f"s AS (SELECT q.vec_id AS query, q.label AS ql, e.vec_id AS item, e.label AS label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_E} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id<>e.vec_id WHERE q.vec_id%100=0), g AS (SELECT query, item FROM s WHERE ql=label), t AS (SELECT query, item, rank, ql%3 AS hop FROM s WHERE rank<=10), n AS (SELECT query, count(*) AS rel FROM g GROUP BY 1)"
_H = ", ".join(f"count(*) FILTER (WHERE g.item IS NOT NULL AND rank<={k}) AS f{k}" for k in (1, 2, 5, 10))
_HS = ", ".join(f"round(avg(CASE WHEN coalesce(rel,0)>0 THEN f{k}/rel ELSE 0 END),9) AS recall_{k}, round(avg((f{k}>0)::INT),9) AS hit_{k}" for k in (1, 2, 5, 10))
_SP = "sp AS (SELECT DISTINCT c AS chunkId, dn AS docName, mv, r.id AS id, r.value.text AS text, r.value.labels[1] AS type, r.value.start AS st, r.value.\"end\" AS en FROM (SELECT c, dn, p.model_version AS mv, unnest(p.result) AS r FROM (SELECT meta.chunkId AS c, meta.docName AS dn, unnest(predictions) AS p FROM ls_import)) WHERE r.type='labels')"
_TK = "x AS (SELECT DISTINCT ON (meta.chunkId) meta.chunkId AS chunkId, string_split(data.text,' ') AS w FROM ls_import WHERE meta.chunkId IS NOT NULL), y AS (SELECT chunkId, unnest(w) AS word, generate_subscripts(w,1)-1 AS i FROM x), tk AS (SELECT chunkId, i, word, coalesce(sum(length(word)+1) OVER (PARTITION BY chunkId ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::INT AS st FROM y)"
_LB = "us AS (SELECT DISTINCT chunkId, st AS ss, en AS se FROM sp WHERE chunkId IS NOT NULL), j AS (SELECT tk.chunkId, i, ss, se, row_number() OVER (PARTITION BY tk.chunkId, ss, se ORDER BY i) AS rn FROM tk JOIN us ON us.chunkId=tk.chunkId AND tk.st>=ss AND tk.st+length(word)<=se), m AS (SELECT chunkId, i, arg_max(rn, struct_pack(a:=ss,b:=se)) AS rn FROM j GROUP BY 1,2), lb AS (SELECT tk.*, CASE WHEN m.rn=1 THEN 'B' WHEN m.rn>1 THEN 'I' ELSE 'O' END AS label FROM tk LEFT JOIN m USING (chunkId, i))"
_CO = "lm AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS e FROM lineitem), co AS (SELECT a.e AS src, b.e AS dst, count(*) AS w FROM lm a JOIN lm b ON a.c=b.c AND a.e<b.e GROUP BY 1,2), adj AS (SELECT src,dst,w FROM co UNION ALL SELECT dst,src,w FROM co)"
_EN = "nn AS (SELECT l_partkey%500 AS id, count(*) AS mentions FROM lineitem GROUP BY 1), en AS (SELECT vec_id AS id, 'n '||(vec_id%211) AS name, label AS type, embedding::DOUBLE[] AS v, coalesce(mentions,0) AS mentions FROM embeddings LEFT JOIN nn ON nn.id=vec_id), lk AS (SELECT a.id AS a, b.id AS b FROM en a JOIN en b ON a.type=b.type AND a.id<>b.id WHERE a.name=b.name OR list_cosine_similarity(a.v,b.v)>=0.4), w(node,r) AS (SELECT a,a FROM lk UNION SELECT lk.b, w.r FROM w JOIN lk ON lk.a=w.node AND w.r<lk.b), cl AS (SELECT node AS id, min(r) AS cluster FROM w GROUP BY 1)"

def majority_share(spark, d):
    l = load(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("found"), F.col("label").alias("true"))
    return M.majority_share(l).select(F.round("share", 9).alias("share"))


def train_split(spark, d):
    return M.train_split(load(spark, d, "documents"), "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def ingest_counts(spark, d):
    return M.ingest_counts(load(spark, d, "parsed_elements"), load(spark, d, "chunks"), _spans(spark, d))


def report_members(spark, d):
    s = load(spark, d, "supplier")
    return D.report_members(_adj(spark, d), s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("label")), s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 9 + 1).alias("words")), 12)


def unknown_phrases(spark, d):
    c = load(spark, d, "chunks").select("chunkId", F.explode("sectionPath").alias("phrase")).distinct()
    return D.unknown_phrases(c, _spans(spark, d)).select("phrase", "n", F.size("chunkIds").alias("chunks"))


def phrase_clusters(spark, d):
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return D.phrase_clusters(v).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        recall_precision_mrr, recall_hit_by_hop, nmi_ari, modularity, plurality_parent, percentile_probe, rank_probe, mean_spread, json_fields, span_prf, gazetteer_build, span_offsets, bio_labels, bio_spans, annotation_roundtrip, explorer_search,
        explorer_type_counts, alignment_components, merge_cluster, leiden_hierarchy, majority_share, train_split, ingest_counts, report_members, unknown_phrases, phrase_clusters,
    )
}
SQL = {
    "recall_precision_mrr": f"WITH {_R}, h AS (SELECT t.query, count(*) FILTER (WHERE g.item IS NOT NULL AND rank<=5) AS f, min(rank) FILTER (WHERE g.item IS NOT NULL) AS fst FROM t LEFT JOIN g ON g.query=t.query AND g.item=t.item GROUP BY 1) SELECT h.query, round(f/rel,9) AS recall, CASE WHEN rel IS NOT NULL THEN round(f/5,9) END AS precision, CASE WHEN rel IS NOT NULL THEN round(coalesce(1.0/fst,0),9) END AS mrr FROM h LEFT JOIN n USING (query)",
    "recall_hit_by_hop": f"WITH {_R}, h AS (SELECT t.query, hop, {_H} FROM t LEFT JOIN g ON g.query=t.query AND g.item=t.item GROUP BY 1,2) SELECT coalesce(hop::VARCHAR,'all') AS hop, count(*) AS queries, {_HS} FROM h LEFT JOIN n USING (query) GROUP BY ROLLUP(hop)",
    "nmi_ari": "WITH l AS (SELECT label AS a, CASE WHEN vec_id%4=0 THEN label%3 ELSE label%5 END AS b FROM embeddings), t AS (SELECT a,b,count(*)::DOUBLE AS n FROM l GROUP BY 1,2), ra AS (SELECT a,sum(n) AS na FROM t GROUP BY 1), rb AS (SELECT b,sum(n) AS nb FROM t GROUP BY 1), k AS (SELECT sum(n) AS nn FROM t), ha AS (SELECT sum(-na/nn*ln(na/nn)) AS ha, sum(na*(na-1)/2) AS ca FROM ra,k), hb AS (SELECT sum(-nb/nn*ln(nb/nn)) AS hb, sum(nb*(nb-1)/2) AS cb FROM rb,k), mi AS (SELECT sum(n/nn*ln(n*nn/(na*nb))) AS mi, sum(n*(n-1)/2) AS cab, max(nn) AS nn FROM t JOIN ra USING (a) JOIN rb USING (b), k) SELECT round(2*mi/(ha+hb),9) AS nmi, round((cab-ca*cb/(nn*(nn-1)/2))/((ca+cb)/2-ca*cb/(nn*(nn-1)/2)),9) AS ari FROM mi,ha,hb",
    "modularity": f"WITH {_CO}, c AS (SELECT a.s_nationkey AS l, sum(w) AS tot, sum(CASE WHEN a.s_nationkey=b.s_nationkey THEN w ELSE 0 END) AS ins FROM adj JOIN supplier a ON a.s_suppkey=src JOIN supplier b ON b.s_suppkey=dst GROUP BY 1), m AS (SELECT sum(tot) AS m2 FROM c) SELECT round(sum(ins/m2-(tot/m2)**2),9) AS modularity FROM c,m",
    "plurality_parent": "WITH n AS (SELECT s_nationkey AS child, s_suppkey%4 AS parent, count(*) AS n FROM supplier GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS rn FROM n) SELECT child, parent, n FROM r WHERE rn=1",
    "percentile_probe": "WITH m AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT round(quantile_cont(n,0.5),6) AS p50, round(quantile_cont(n,0.95),6) AS p95, round(quantile_cont(n,0.99),6) AS p99, max(n) AS max FROM m",
    "rank_probe": "WITH e AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY n DESC)::INT AS rank FROM e) SELECT o_custkey, n, rank FROM r WHERE rank<=40",
    "mean_spread": "SELECT event_type, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS spread FROM events GROUP BY 1",
    "json_fields": "SELECT event_type, (props::JSON->>'k')::INT AS k, count(*) AS n FROM events GROUP BY 1,2",
    "span_prf": f"WITH {_SP}, a AS (SELECT DISTINCT chunkId,st,en FROM sp WHERE chunkId IS NOT NULL AND type IN ('Person','BankingInstitution')), b AS (SELECT DISTINCT chunkId,st,en FROM sp WHERE chunkId IS NOT NULL AND length(text)>14), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS fp, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS fn) SELECT tp, fp, fn, round(tp/(tp+fp),9) AS precision, round(tp/(tp+fn),9) AS recall, round(2*tp/(2*tp+fp+fn),9) AS f1 FROM c",
    "gazetteer_build": f"WITH {_SP}, n AS (SELECT type, text, id, trim(regexp_replace(translate(regexp_replace(text,'[\\x{{064B}}-\\x{{065F}}]','','g'),'أإآى','اااي'),'\\s+',' ','g')) AS norm FROM sp WHERE length(text)%5<>0), g AS (SELECT type, norm, arg_min(text,id) AS s FROM n GROUP BY 1,2) SELECT type, array_to_string(list_sort(list(DISTINCT s)),'|') AS surfaces FROM g GROUP BY 1",
    "span_offsets": f"WITH {_TK} SELECT chunkId, count(*) AS tokens, max(st+length(word))::INT AS \"end\", sum(st)::BIGINT AS starts FROM tk GROUP BY 1",
    "bio_labels": f"WITH {_SP}, {_TK}, {_LB} SELECT chunkId, label, count(*) AS n FROM lb GROUP BY 1,2",
    "bio_spans": f"WITH {_SP}, {_TK}, {_LB}, g AS (SELECT *, sum(CASE WHEN label='I' THEN 0 ELSE 1 END) OVER (PARTITION BY chunkId ORDER BY i) AS g FROM lb) SELECT chunkId, min(st)::INT AS start, max(st+length(word))::INT AS \"end\", string_agg(word,' ' ORDER BY i) AS text FROM g WHERE label<>'O' GROUP BY chunkId, g HAVING arg_min(label,i)='B'",
    "annotation_roundtrip": f"WITH {_SP}, s AS (SELECT DISTINCT chunkId,id,text,type,st,en FROM sp WHERE chunkId IS NOT NULL) SELECT type, count(*) AS n, count(DISTINCT chunkId) AS chunks FROM s GROUP BY 1",
    "explorer_search": "WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS chunks FROM lineitem GROUP BY 1) SELECT p_partkey, substr(p_name,1,40) AS label, coalesce(chunks,0) AS chunks FROM part LEFT JOIN n ON l_partkey=p_partkey WHERE (contains(lower(p_name),'green') OR contains(p_partkey::VARCHAR,'99')) AND p_brand IS NOT NULL ORDER BY 3 DESC, 1 LIMIT 30",
    "explorer_type_counts": "SELECT p_brand, count(*) AS nodes, count(DISTINCT p_type) AS types FROM part GROUP BY 1",
    "alignment_components": f"WITH RECURSIVE {_EN} SELECT id, cluster FROM cl",
    "merge_cluster": f"WITH RECURSIVE {_EN}, r AS (SELECT cl.id, cluster, first_value(en.id) OVER (PARTITION BY cluster ORDER BY mentions DESC, length(name) DESC, en.id) AS canonical FROM cl JOIN en USING (id)) SELECT id, canonical FROM r",
    "majority_share": "WITH n AS (SELECT vec_id%7 AS f, label, count(*) AS n FROM embeddings GROUP BY 1,2), g AS (SELECT f, max(n) AS m, sum(n) AS a FROM n GROUP BY 1) SELECT round(sum(m)/sum(a),9) AS share FROM g",
    "train_split": "SELECT CASE WHEN ('0x'||substr(md5('42:'||doc_id),1,8))::BIGINT%10000 < 8000 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM documents GROUP BY 1",
    "ingest_counts": f"WITH {_SP}, e AS (SELECT docName, count(DISTINCT elementId) AS elements FROM parsed_elements GROUP BY 1), c AS (SELECT docName, count(DISTINCT chunkId) AS chunks FROM chunks GROUP BY 1), m AS (SELECT docName, count(DISTINCT text) AS entities FROM sp GROUP BY 1), a AS (SELECT docName FROM e UNION SELECT docName FROM c UNION SELECT docName FROM m WHERE docName IS NOT NULL) SELECT a.docName, coalesce(elements,0) AS elements, coalesce(chunks,0) AS chunks, coalesce(entities,0) AS entities FROM a LEFT JOIN e USING (docName) LEFT JOIN c USING (docName) LEFT JOIN m USING (docName)",
    "report_members": f"WITH {_CO}, dg AS (SELECT src AS node, sum(w) AS degree FROM adj GROUP BY 1), j AS (SELECT s_suppkey AS node, s_nationkey AS label, degree, s_suppkey%9+1 AS words FROM supplier LEFT JOIN dg ON node=s_suppkey), r AS (SELECT *, row_number() OVER w AS rank, sum(words) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM j WINDOW w AS (PARTITION BY label ORDER BY degree DESC NULLS LAST, node)) SELECT label, node, rank::INT AS rank FROM r WHERE used<=12",
    "unknown_phrases": f"WITH {_SP}, c AS (SELECT DISTINCT chunkId, unnest(sectionPath) AS phrase FROM chunks), n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.chunkId=c.chunkId AND sp.text=c.phrase)) SELECT phrase, count(*) AS n, count(DISTINCT chunkId)::INT AS chunks FROM n GROUP BY 1 HAVING count(*)>=3",
}
