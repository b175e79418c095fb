"""Blocks, sections, chunks, ids and word features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking as C
from quillgraph.operators import metrics as M
from quillgraph.operators import ner as N
from quillgraph.sources.tables import load


def doc_blocks(spark, d):
    b = C.doc_blocks(load(spark, d, "documents"), "doc_id", "text")
    return b.select("doc_id", "pos", "kind", "level", F.length("block").alias("chars"))


def section_paths(spark, d):
    p = C.section_paths(load(spark, d, "documents"), "doc_id", "text")
    return p.select("doc_id", "pos", "kind", F.array_join("path", " > ").alias("path"))


def section_islands(spark, d):
    i = C.section_islands(load(spark, d, "parsed_elements"))
    return i.groupBy("docName", "island").agg(F.count(F.lit(1)).alias("elements"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def chunk_pack(spark, d):
    c = C.chunk_elements(load(spark, d, "parsed_elements"), budget=120)
    return c.select("chunkId", "docName", F.size("elementIds").alias("elements"), F.size("pages").alias("pages"), F.length("text").alias("chars"), "accessLevel")


def semantic_chunk_pack(spark, d):
    from quillgraph.operators.hooks import hashed_embedding

    return C.semantic_chunks(load(spark, d, "documents"), "doc_id", "text", hashed_embedding, 95.0)


def sentence_split(spark, d):
    s = load(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"))


def token_counts(spark, d):
    m = load(spark, d, "messages")
    return m.groupBy(F.lower(F.trim("role")).alias("role")).agg(F.sum(X.count_tokens(F.col("content"))).alias("words"), F.count(F.lit(1)).alias("n"))


def token_truncation(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.truncate_tokens(F.col("text"), 80)).alias("head"))


def content_hash_dedupe(spark, d):
    return C.content_ids(load(spark, d, "documents"), "doc_id", "text")


def normalised_ids(spark, d):
    t = load(spark, d, "chunks").select(F.explode("sectionPath").alias("t")).distinct()
    return t.select("t", X.normalize_arabic(F.col("t")).alias("norm"), X.slug(F.col("t")).alias("slug"), X.canonical_key(F.col("t")).alias("key"))


def _words(spark, d):
    """The distinct words of all chunk texts."""
    t = load(spark, d, "chunks").select(F.translate("text", "\n\t", "  ").alias("t"))
    return t.select(F.explode(F.split("t", " ")).alias("w")).where("w != ''").distinct()


def char_ngrams(spark, d):
    return _words(spark, d).select(F.explode(X.char_ngrams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def script_features(spark, d):
    w = _words(spark, d).union(load(spark, d, "message_citations").select(F.regexp_extract("chunkId", "([^_]*)$", 1)).distinct()).where("w != ''").distinct()
    return w.select("w", *[c.alias(n) for n, c in X.script_features(F.col("w")).items()], F.coalesce(X.arabic_share(F.col("w")) >= 0.10, F.lit(False)).alias("is_arabic"))


def morph_features(spark, d):
    return _words(spark, d).select("w", *[c.alias(n) for n, c in X.morph_features(F.col("w")).items()])


def token_window_features(spark, d):
    t = load(spark, d, "chunks").select("chunkId", F.col("text").alias("t")).distinct()
    f = N.token_windows(t, ["chunkId", "t"], "t")
    return f.groupBy("w_2", "w_1", "w", "w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def chunk_stats(spark, d):
    s = M.value_stats(load(spark, d, "v2_chunks"), "token_estimate", ["element_type"])
    return s.withColumn("mean", F.round("mean", 6))


def url_functions(spark, d):
    u = load(spark, d, "chunks").select("docName", "chunkId").distinct().select(F.concat(F.lit("https://host.example/-/laws/"), F.replace("chunkId", F.lit(" "), F.lit("%20")), F.when(F.length("chunkId") % 3 == 0, ".pdf?pageNo=4&x=1#top").when(F.length("chunkId") % 3 == 1, "?pageNo=19").otherwise(".png.pdf")).alias("u"))
    return u.select("u", X.without_fragment(F.col("u")).alias("bare"), X.is_pdf(F.col("u")).alias("pdf"), X.next_page(F.col("u")).alias("next"))


def stratified_sample(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("_")).alias("source"))
    return M.stratified_sample(docs, "source", "doc_id", 40, 8).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def context_blocks(spark, d):
    c = load(spark, d, "chunks").dropDuplicates(["chunkId"])
    return c.select("chunkId", F.md5(X.context_block(F.col("chunkId"), F.col("sectionPath"), F.col("pages"), F.col("text"))).alias("block"))


_ST = "regexp_replace({0},'^\\s+|\\s+$','','g')"
_BL = "bl AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text,'\\n\\s*\\n'), lambda b: regexp_replace(b,'^\\s+|\\s+$','','g')), lambda b: b<>'') AS b FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(b) AS block, generate_subscripts(b,1)-1 AS pos FROM bl)"
_KIND = "CASE WHEN starts_with(block,'#') THEN 'heading' WHEN starts_with(block,'|') THEN 'table' WHEN regexp_matches(split_part(block,chr(10),1),'^([-*+]|[0-9]+\\.)\\s') THEN 'list' ELSE 'paragraph' END"
_W = "t AS (SELECT translate(text, chr(10)||chr(9), '  ') AS t FROM chunks), w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(t,' ')) AS w FROM t) WHERE w<>'')"
_TOK = "CASE WHEN regexp_replace(coalesce(content,''),'^\\s+|\\s+$','','g')='' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(content,'^\\s+|\\s+$','','g'),'\\s+')) END"
_PRE = "CASE " + " ".join(f"WHEN starts_with(w,'{p}') THEN substr(w,{len(p) + 1})" for p in X.PREFIXES) + " " + " ".join(f"WHEN starts_with(w,'{p}') AND length(w)>{len(p) + 1} THEN substr(w,{len(p) + 1})" for p in X.CLITICS) + " ELSE w END"
_U = "u AS (SELECT 'https://host.example/-/laws/'||replace(chunkId,' ','%20')||CASE WHEN length(chunkId)%3=0 THEN '.pdf?pageNo=4&x=1#top' WHEN length(chunkId)%3=1 THEN '?pageNo=19' ELSE '.png.pdf' END AS u FROM (SELECT DISTINCT docName, chunkId FROM chunks))"

QUERIES = {
    f.__name__: f
    for f in (
        doc_blocks, section_paths, section_islands, chunk_pack, semantic_chunk_pack, sentence_split, token_counts, token_truncation, content_hash_dedupe, normalised_ids, char_ngrams, script_features, morph_features, token_window_features, chunk_stats,
        url_functions, stratified_sample, context_blocks,
    )
}
SQL = {
    "doc_blocks": f"WITH {_BL} SELECT doc_id, pos, {_KIND} AS kind, length(regexp_extract(block,'^(#+)',1)) AS level, length(block) AS chars FROM e",
    "section_islands": "WITH d AS (SELECT DISTINCT ON (elementId) * FROM parsed_elements WHERE elementType<>'heading'), s AS (SELECT *, regexp_extract(elementId,'([0-9]{1,18})$',1)::BIGINT AS seq FROM d), f AS (SELECT *, CASE WHEN row_number() OVER w=1 THEN 1 WHEN lag(sectionPath) OVER w IS NOT DISTINCT FROM sectionPath THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY docName ORDER BY seq, elementId)), i AS (SELECT *, sum(nw) OVER (PARTITION BY docName ORDER BY seq, elementId) AS island FROM f) SELECT docName, island::BIGINT AS island, count(*) AS elements, min(seq) AS first, max(seq) AS last FROM i GROUP BY 1,2",
    "sentence_split": "WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text,'^\\s+|\\s+$','','g'),'([.!?؟])\\s+','\\1'||chr(1),'g'),chr(1)), lambda x: trim(x)<>'') AS s FROM documents) SELECT doc_id, len(s)::INT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))),0)::INT AS longest FROM s",
    "token_counts": f"SELECT lower(trim(role)) AS role, sum({_TOK})::BIGINT AS words, count(*) AS n FROM messages GROUP BY 1",
    "token_truncation": "WITH t AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text,'^\\s+|\\s+$','','g'),'\\s+') AS w FROM documents) SELECT doc_id, md5(CASE WHEN text IS NULL THEN '' WHEN len(w)<=80 THEN text ELSE array_to_string(w[1:80],' ') END) AS head FROM t",
    "content_hash_dedupe": "SELECT substr(sha256(text),1,16) AS content_id, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "normalised_ids": "WITH t AS (SELECT DISTINCT unnest(sectionPath) AS t FROM chunks) SELECT t, trim(regexp_replace(translate(regexp_replace(t,'[\\x{064B}-\\x{065F}]','','g'),'أإآى','اااي'),'\\s+',' ','g')) AS norm, lower(regexp_replace(trim(t),'\\s+','-','g')) AS slug, lower(trim(regexp_replace(t,'\\s+',' ','g'))) AS key FROM t",
    "char_ngrams": f"WITH {_W}, g AS (SELECT DISTINCT w, 'c2_'||substr(w,i,2) AS gram FROM w, range(1,60) r(i) WHERE i<=length(w)-1 UNION SELECT DISTINCT w, 'c3_'||substr(w,i,3) FROM w, range(1,60) r(i) WHERE i<=length(w)-2) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "script_features": f"WITH {_W}, x AS (SELECT w FROM w UNION SELECT regexp_extract(chunkId,'([^_]*)$',1) FROM message_citations WHERE chunkId IS NOT NULL) SELECT w, regexp_matches(w,'^[٠-٩]+$') AS is_arabic_num, regexp_matches(w,'^[0-9]+$') AS is_western_num, regexp_matches(w,'[a-zA-Z]') AS contains_latin, regexp_matches(w,'^[0-9٠-٩]+-[0-9٠-٩]+(-[0-9٠-٩]+)*$') AS is_clause_ref, regexp_matches(w,'^[A-Z]{{2,6}}$') AS is_abbreviation, coalesce(len(regexp_extract_all(w,'[\\x{{0600}}-\\x{{06FF}}]'))/nullif(len(regexp_extract_all(w,'\\p{{L}}')),0)>=0.1,false) AS is_arabic FROM x WHERE w<>''",
    "morph_features": f"WITH {_W}, s AS (SELECT w, {_PRE} AS st FROM w) SELECT w, starts_with(st,'ال') AS has_def_art, regexp_matches(w,'^(بال|لل|كال|وال|فال|ب|ل|ك|و|ف)') AS has_prep_clitic, CASE WHEN starts_with(st,'ال') THEN substr(st,3) ELSE st END AS stem FROM s",
    "token_window_features": "WITH t AS (SELECT DISTINCT chunkId, text AS t FROM chunks), x AS (SELECT chunkId, t, regexp_extract_all(t,'([0-9٠-٩]+-[0-9٠-٩]+(?:-[0-9٠-٩]+)*|[\\x{0600}-\\x{06FF}a-zA-Z0-9]+|[^\\s])',1) AS ws FROM t), p AS (SELECT chunkId, t, unnest(ws) AS w, generate_subscripts(ws,1) AS i FROM x), f AS (SELECT w, coalesce(lag(w,2) OVER o,'__START__') AS w_2, coalesce(lag(w,1) OVER o,'__START__') AS w_1, coalesce(lead(w,1) OVER o,'__END__') AS w1, coalesce(lead(w,2) OVER o,'__END__') AS w2 FROM p WINDOW o AS (PARTITION BY chunkId,t ORDER BY i)) SELECT w_2,w_1,w,w1,w2,count(*) AS n FROM f GROUP BY ALL",
    "chunk_stats": "SELECT element_type, count(*) AS n, min(token_estimate) AS least, max(token_estimate) AS most, round(avg(token_estimate),6) AS mean, sum(token_estimate)::BIGINT AS total FROM v2_chunks GROUP BY 1",
    "url_functions": f"WITH {_U} SELECT u, regexp_replace(u,'#.*$','') AS bare, (NOT regexp_matches(split_part(lower(u),'?',1),'\\.(png|jpg|jpeg|gif|svg)') AND (ends_with(split_part(lower(u),'?',1),'.pdf') OR contains(split_part(lower(u),'?',1),'/-/media/'))) AS pdf, CASE WHEN regexp_matches(u,'pageNo=[0-9]+') THEN regexp_extract(u,'^(.*?pageNo=)[0-9]+',1)||(regexp_extract(u,'pageNo=([0-9]+)',1)::BIGINT+1)||regexp_extract(u,'pageNo=[0-9]+(.*)$',1) END AS next FROM u",
    "stratified_sample": "WITH c AS (SELECT coalesce(lower(trim(source)),'_') AS source, least(count(*),5) AS n FROM documents GROUP BY 1) SELECT source, n FROM c",
    "context_blocks": "SELECT DISTINCT ON (chunkId) chunkId, md5('['||chunkId||' | section: '||array_to_string(sectionPath,' > ')||' | pages: '||array_to_string(list_filter(pages, lambda p: p IS NOT NULL),', ')||']'||chr(10)||text) AS block FROM chunks",
}
