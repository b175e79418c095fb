"""Canonical entities, relationships, triples and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import entities as E
from quillgraph.operators import graph as G
from quillgraph.sources.tables import load

# Types lent to part brands and suppliers, so that the rules have something to judge.
_PART_TYPE = "element_at(array('License', 'Document', 'Law', 'Article', 'Person'), cast(p_partkey % 5 + 1 as int))"
_SUPP_TYPE = "element_at(array('RegulatoryBody', 'Person', 'BankingInstitution', 'Date'), cast(s_suppkey % 4 + 1 as int))"
_PREDICATE = "element_at(array('issued-by', 'GOVERNS', 'effective-from', 'unknown'), cast(l_linenumber % 4 + 1 as int))"


def _spans(spark, d):
    r = load(spark, d, "ls_import").select(F.col("meta.chunkId").alias("chunkId"), F.col("meta.docName").alias("docName"), F.explode("predictions").alias("p")).select("chunkId", "docName", F.explode("p.result").alias("r"))
    return r.select(F.col("r.id").alias("seq"), "chunkId", "docName", F.col("r.value.text").alias("text"), F.get("r.value.labels", F.lit(0)).alias("type")).where("chunkId is not null").distinct()


def canonical_entities_global(spark, d):
    e = E.canonical_global(_spans(spark, d))
    return e.select("canonicalId", "canonicalName", "type", F.array_join("aliases", "|").alias("aliases"), F.array_join("chunkIds", "|").alias("chunkIds"))


def canonical_entities_docscoped(spark, d):
    e = E.canonical_in_doc(_spans(spark, d))
    return e.select("canonicalId", "canonicalName", "type", F.array_join("aliases", "|").alias("aliases"), F.array_join("chunkIds", "|").alias("chunkIds"), "docName")


def typed_relationship_validation(spark, d):
    parts = load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.expr(_PART_TYPE).alias("type"))
    supps = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.expr(_SUPP_TYPE).alias("type"))
    rel = load(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("subject"), F.expr(_PREDICATE).alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("object"))
    v = E.valid_relations(rel, parts.unionByName(supps))
    return v.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject", "object").alias("edges"))


def _triples(spark, d):
    t = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    # some objects are their own subject, some a word of a part's name, some a nation, which no surface is
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    o = F.when(F.col("l_linenumber") == 7, F.col("s_name")).when(F.col("l_linenumber") == 6, F.substring_index("p_name", " ", 1)).when(F.col("l_linenumber") == 5, F.col("n_name")).otherwise(F.col("p_name"))
    return t.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.upper("s_name").alias("subject"), F.col("l_returnflag").alias("predicate"), o.alias("object"))


def _surfaces(spark, d):
    """Surfaces of all suppliers and parts."""
    s = load(spark, d, "supplier").select(F.lower("s_name").alias("surface"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    p = load(spark, d, "part").groupBy(F.lower("p_name").alias("surface")).agg(F.min("p_partkey").alias("k")).select("surface", F.concat(F.lit("p"), "k").alias("id"))
    return s.unionByName(p)


def triple_edges(spark, d):
    e, _ = E.triple_edges(_triples(spark, d), _surfaces(spark, d))
    return e.select("src", "dst", "weight", F.array_join("predicates", "|").alias("predicates"))


def triple_drop_counts(spark, d):
    return E.triple_edges(_triples(spark, d), _surfaces(spark, d))[1]


def alias_union_upsert(spark, d):
    p = load(spark, d, "part").select(F.col("p_brand").alias("canonicalId"), F.col("p_brand").alias("canonicalName"), F.lit("Brand").alias("type"), "p_type", "p_partkey")
    batch = lambda df: df.groupBy("canonicalId", "canonicalName", "type").agg(F.sort_array(F.collect_set("p_type")).alias("aliases"), F.sort_array(F.collect_set(F.col("p_partkey").cast("string"))).alias("chunkIds"))
    m = E.merge_aliases(batch(p.where("p_partkey % 2 = 0")), batch(p.where("p_partkey % 2 = 1")))
    return m.select("canonicalId", F.array_join("aliases", "|").alias("aliases"), F.size("chunkIds").alias("chunks"))


def alias_prepend_upsert(spark, d):
    p = load(spark, d, "part")
    old = p.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("old"))
    new = p.where("p_partkey % 2 = 1").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("new"))
    return old.join(new, "p_brand").select("p_brand", F.array_join(E.prepend_aliases(F.col("old"), F.col("new")), "|").alias("aliases"))


def edge_upsert_chunkids(spark, d):
    e = load(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_returnflag").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_orderkey").alias("chunk"))
    n = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return E.merge_edges(e, n).select("src", "predicate", "dst", F.array_join(F.transform("chunkIds", lambda x: x.cast("string")), "|").alias("chunkIds"))


def node_upsert(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return E.upsert(c.where("c_custkey % 3 != 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"]).groupBy((F.col("c_acctbal") == 0).alias("fresh")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def insert_if_absent(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return E.upsert(c.where("c_custkey % 3 != 0"), c.withColumn("c_acctbal", F.lit(-1.0)), ["c_custkey"], prefer_new=False).groupBy((F.col("c_acctbal") == -1).alias("fresh")).agg(F.count(F.lit(1)).alias("n"))


def detach_delete(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("entity"))
    e = G.comention_edges(m)
    n = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    nodes, edges = E.detach_delete(n, e, n.where("id % 7 = 0"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")))


def csv_style_node_union(spark, d):
    parts = [("customer", "c_custkey", "c_name", "c_mktsegment"), ("supplier", "s_suppkey", "s_name", None), ("nation", "n_nationkey", "n_name", None)]
    out = None
    for t, k, n, j in parts:
        df = load(spark, d, t).select(F.concat_ws("-", F.lit("ext"), F.lit(t), k).alias("canonicalId"), F.coalesce(F.nullif(F.trim(n), F.lit("")), F.col(k).cast("string")).alias("name"), (F.coalesce(j, F.lit("")) if j else F.lit("")).alias("jurisdiction"), F.lit(t).alias("type"))
        out = df if out is None else out.unionByName(df)
    return out


def link_names(spark, d):
    return load(spark, d, "orders").select(X.link_name(F.col("o_orderpriority")).alias("link"), X.link_name(F.concat(F.lit("--"), "o_orderstatus", F.lit(" .. "))).alias("status")).groupBy("link", "status").agg(F.count(F.lit(1)).alias("n"))


def orphan_endpoints(spark, d):
    t = _triples(spark, d)
    ends = t.select(F.lower(F.trim("subject")).alias("surface")).union(t.select(F.lower(F.trim("object"))))
    return ends.distinct().join(_surfaces(spark, d), "surface", "left_anti")


def token_subset_match(spark, d):
    o = orphan_endpoints(spark, d).select("surface", X.word_set(F.col("surface")).alias("t"))
    e = _surfaces(spark, d).select("id", F.col("surface").alias("name"), X.word_set(F.col("surface")).alias("u"))
    w = o.select("surface", "t", F.explode("t").alias("w")).join(e.select("id", "name", "u", F.explode("u").alias("w")), "w").drop("w").distinct()
    sup = F.size(F.array_except("t", "u")) == 0
    sub = F.size(F.array_except("u", "t")) == 0
    c = w.withColumn("rank", F.when(sup & ~sub, 1).when(sub & ~sup, 2)).where("rank is not null")
    return c.groupBy("surface").agg(F.min(F.struct("rank", "name")).alias("m")).select("surface", "m.rank", "m.name")


_SPANS = "sp AS (SELECT DISTINCT r.id AS seq, c AS chunkId, dn AS docName, r.value.text AS text, r.value.labels[1] AS type FROM (SELECT c, dn, unnest(p.result) AS r FROM (SELECT meta.chunkId AS c, meta.docName AS dn, unnest(predictions) AS p FROM ls_import)) WHERE c IS NOT NULL AND r.value.text IS NOT NULL)"
_NORM = "trim(regexp_replace(translate(regexp_replace(text,'[\\x{064B}-\\x{065F}]','','g'),'أإآى','اااي'),'\\s+',' ','g'))"
_TYPES = ",".join(repr(t) for t in E.TYPES)
_PT = "(['License','Document','Law','Article','Person'])[(p_partkey%5+1)::INT]"
_STY = "(['RegulatoryBody','Person','BankingInstitution','Date'])[(s_suppkey%4+1)::INT]"
_PR = "(['issued-by','GOVERNS','effective-from','unknown'])[(l_linenumber%4+1)::INT]"
_RULES = " UNION ALL ".join(f"SELECT '{p}' AS p, {s!r} AS s, {o!r} AS o" for p, (s, o) in E.RELATIONS.items())
_TRIP = "tr AS (SELECT upper(s_name) AS subject, l_returnflag AS predicate, CASE WHEN l_linenumber=7 THEN s_name WHEN l_linenumber=6 THEN split_part(p_name,' ',1) WHEN l_linenumber=5 THEN n_name ELSE p_name END AS object FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey), su AS (SELECT lower(s_name) AS surface, 's'||s_suppkey AS id FROM supplier UNION ALL SELECT lower(p_name), 'p'||min(p_partkey) FROM part GROUP BY 1), j AS (SELECT a.id AS src, b.id AS dst, predicate FROM tr LEFT JOIN su a ON a.surface=lower(trim(subject)) LEFT JOIN su b ON b.surface=lower(trim(object)))"
_ORPH = "en AS (SELECT DISTINCT lower(trim(subject)) AS surface FROM tr UNION SELECT lower(trim(object)) FROM tr), orp AS (SELECT surface FROM en WHERE surface NOT IN (SELECT surface FROM su))"
_WS = "list_distinct(list_filter(regexp_split_to_array(lower({0}),'[^\\p{{L}}\\p{{N}}_]+'), lambda x: x<>''))"

QUERIES = {
    f.__name__: f
    for f in (
        canonical_entities_global, canonical_entities_docscoped, typed_relationship_validation, triple_edges, triple_drop_counts, alias_union_upsert, alias_prepend_upsert, edge_upsert_chunkids, node_upsert, insert_if_absent, detach_delete,
        csv_style_node_union, link_names, orphan_endpoints, token_subset_match,
    )
}
SQL = {
    "canonical_entities_global": f"WITH {_SPANS}, n AS (SELECT *, {_NORM} AS norm FROM sp WHERE type IN ({_TYPES})), f AS (SELECT norm,type,text,min(seq) AS seq FROM n GROUP BY ALL), g AS (SELECT norm,type,list(text ORDER BY seq,text) AS t FROM f GROUP BY ALL), c AS (SELECT norm,type,list_sort(list(DISTINCT chunkId)) AS cs FROM n GROUP BY ALL) SELECT lower(regexp_replace(norm,'\\s+','-','g'))||'-'||type AS canonicalId, t[1] AS canonicalName, type, array_to_string(t[2:],'|') AS aliases, array_to_string(cs,'|') AS chunkIds FROM g JOIN c USING (norm,type)",
    "canonical_entities_docscoped": f"WITH {_SPANS}, n AS (SELECT *, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS k FROM sp), g AS (SELECT docName,k,type,arg_min(text,seq) AS nm, list_sort(list(DISTINCT text)) AS t, list_sort(list(DISTINCT chunkId)) AS cs FROM n GROUP BY ALL) SELECT concat_ws('-',docName,regexp_replace(k,'\\s+','-','g'),type) AS canonicalId, nm AS canonicalName, type, array_to_string(list_filter(t, lambda x: x<>nm),'|') AS aliases, array_to_string(cs,'|') AS chunkIds, docName FROM g",
    "typed_relationship_validation": f"WITH ru AS ({_RULES}), ty AS (SELECT 'p'||p_partkey AS id, {_PT} AS type FROM part UNION ALL SELECT 's'||s_suppkey, {_STY} FROM supplier), rel AS (SELECT 'p'||l_partkey AS subject, upper(replace({_PR},'-','_')) AS predicate, 's'||l_suppkey AS object FROM lineitem) SELECT predicate, count(*) AS n, count(DISTINCT subject||'|'||object) AS edges FROM rel JOIN ty a ON a.id=subject JOIN ty b ON b.id=object JOIN ru ON p=predicate WHERE list_contains(s,a.type) AND list_contains(o,b.type) GROUP BY 1",
    "triple_edges": f"WITH {_TRIP} SELECT src,dst,count(*) AS weight, array_to_string(list_sort(list(DISTINCT predicate)),'|') AS predicates FROM j WHERE src<>dst GROUP BY ALL",
    "triple_drop_counts": f"WITH {_TRIP} SELECT count(*) AS raw, count(*) FILTER (WHERE src IS NULL OR dst IS NULL) AS unmatched, count(*) FILTER (WHERE src=dst) AS self_ref FROM j",
    "alias_union_upsert": "WITH o AS (SELECT p_brand AS b, list_sort(list(DISTINCT p_type)) AS t FROM part WHERE p_partkey%2=0 GROUP BY 1), n AS (SELECT p_brand AS b, list_sort(list(DISTINCT p_type)) AS t FROM part WHERE p_partkey%2=1 GROUP BY 1), c AS (SELECT p_brand AS b, count(DISTINCT p_partkey)::INT AS chunks FROM part GROUP BY 1) SELECT c.b AS canonicalId, array_to_string(list_concat(coalesce(o.t,[]), list_filter(coalesce(n.t,[]), lambda x: NOT list_contains(coalesce(o.t,[]),x))),'|') AS aliases, chunks FROM c LEFT JOIN o USING (b) LEFT JOIN n USING (b)",
    "alias_prepend_upsert": "WITH o AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM part WHERE p_partkey%2=0 GROUP BY 1), n AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM part WHERE p_partkey%2=1 GROUP BY 1) SELECT p_brand, array_to_string(list_concat(list_filter(n.t, lambda x: NOT list_contains(o.t,x)), o.t),'|') AS aliases FROM o JOIN n USING (p_brand)",
    "edge_upsert_chunkids": "SELECT 's'||l_suppkey AS src, l_returnflag AS predicate, 'p'||l_partkey AS dst, array_to_string(list_sort(list(DISTINCT l_orderkey)),'|') AS chunkIds FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL",
    "node_upsert": "WITH u AS (SELECT c_custkey, 0.0 AS c_acctbal FROM customer WHERE c_custkey%2=0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey%3<>0 AND c_custkey%2<>0) SELECT c_acctbal=0 AS fresh, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM u GROUP BY 1",
    "insert_if_absent": "WITH u AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey%3<>0 UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE c_custkey%3=0) SELECT c_acctbal=-1 AS fresh, count(*) AS n FROM u GROUP BY 1",
    "detach_delete": "WITH m AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey AS entity FROM lineitem), e AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM m a JOIN m b ON a.chunk=b.chunk AND a.entity<b.entity GROUP BY 1,2) SELECT (SELECT count(*) FROM supplier WHERE s_suppkey%7<>0) AS nodes, count(*) AS edges, sum(weight)::BIGINT AS weight FROM e WHERE src%7<>0 AND dst%7<>0",
    "csv_style_node_union": "SELECT 'ext-customer-'||c_custkey AS canonicalId, coalesce(nullif(trim(c_name),''),c_custkey::VARCHAR) AS name, coalesce(c_mktsegment,'') AS jurisdiction, 'customer' AS type FROM customer UNION ALL SELECT 'ext-supplier-'||s_suppkey, coalesce(nullif(trim(s_name),''),s_suppkey::VARCHAR), '', 'supplier' FROM supplier UNION ALL SELECT 'ext-nation-'||n_nationkey, coalesce(nullif(trim(n_name),''),n_nationkey::VARCHAR), '', 'nation' FROM nation",
    "link_names": "WITH l AS (SELECT coalesce(nullif(upper(regexp_replace(regexp_replace(o_orderpriority,'[^A-Za-z0-9]+','_','g'),'^_+|_+$','','g')),''),'LINKED_TO') AS link, coalesce(nullif(upper(regexp_replace(regexp_replace('--'||o_orderstatus||' .. ','[^A-Za-z0-9]+','_','g'),'^_+|_+$','','g')),''),'LINKED_TO') AS status FROM orders) SELECT link,status,count(*) AS n FROM l GROUP BY ALL",
    "orphan_endpoints": f"WITH {_TRIP}, {_ORPH} SELECT surface FROM orp",
    "token_subset_match": f"WITH {_TRIP}, {_ORPH}, o AS (SELECT surface, {_WS.format('surface')} AS t FROM orp), e AS (SELECT id, surface AS name, {_WS.format('surface')} AS u FROM su), c AS (SELECT o.surface, e.name, CASE WHEN list_has_all(u,t) AND NOT list_has_all(t,u) THEN 1 WHEN list_has_all(t,u) AND NOT list_has_all(u,t) THEN 2 END AS rank FROM o, e WHERE list_has_any(t,u)), r AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY rank, name) AS rn FROM c WHERE rank IS NOT NULL) SELECT surface, rank, name FROM r WHERE rn=1",
}
