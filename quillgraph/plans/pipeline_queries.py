"""Readers, sinks, service requests and composed pipelines as queries; tables are written to the shared folder and read again."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import align as A
from quillgraph.operators import chunking as C
from quillgraph.operators import community as CM
from quillgraph.operators import crawl as W
from quillgraph.operators import entities as E
from quillgraph.operators import graph as G
from quillgraph.operators import hooks as H
from quillgraph.operators import metrics as M
from quillgraph.operators import ner as N
from quillgraph.operators import ppr as P
from quillgraph.operators import retrieval as R
from quillgraph.operators import service as S
from quillgraph.operators import vector as V
from quillgraph.plans import metric_queries as MQ
from quillgraph.plans import vector_queries as VQ
from quillgraph.runtime import shared_folder
from quillgraph.sources import office as O
from quillgraph.sources import readers as RD
from quillgraph.sources import writers as WR
from quillgraph.sources.tables import load
from quillgraph.streaming import jobs as J


def json_dump_roundtrip(spark, d):
    """Chunks as one JSON array per document, read back by a glob."""
    out = shared_folder(spark, "json")
    WR.json_documents(load(spark, d, "chunks"), out)
    back = RD.json_arrays(spark, out + "/*/*", RD.CHUNK)
    return back.groupBy("docName").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("elementIds")).alias("elements"))


def jsonl_scan(spark, d):
    out = shared_folder(spark, "jsonl")
    load(spark, d, "messages").select("id", "chatId", "role", "content").write.json(out)
    back = RD.json_lines(spark, out, "id string, chatId string, role string, content string")
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def csv_graph_scan(spark, d):
    """Node and edge files with headers: customers, orders and who placed what."""
    out = shared_folder(spark, "csv")
    load(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("countries")).write.option("header", True).csv(out + "/customer")
    load(spark, d, "orders").select(F.col("o_orderkey").alias("id")).write.option("header", True).csv(out + "/orders")
    load(spark, d, "orders").select(F.col("o_custkey").alias("node_id_start"), F.concat(F.lit("o"), "o_orderkey").alias("node_id_end"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("placed")).alias("link")).write.option("header", True).csv(out + "/edges")
    n = RD.graph_nodes(spark, {"customer": out + "/customer", "order": out + "/orders"}).groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("jurisdiction").alias("kinds"))
    e = RD.graph_edges(spark, out + "/edges").groupBy(F.col("link").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("kinds"))
    return n.unionByName(e)


def _docx(rows: list[tuple[str, ...]]) -> bytes:
    """A small word-processor file: two headings, a sentence and a table of the rows."""
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = p("World", "Heading1") + p("Regions", "Heading2") + p("All regions follow.") + table + p("End", "Heading1") + p("")
    doc = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", doc)
    return out.getvalue()


def docx_elements(spark, d):
    """The regions (a fixed table of five rows) as a word-processor file, uploaded, routed and parsed."""
    folder = shared_folder(spark, "docx")
    rows = sorted((str(r.r_regionkey), r.r_name) for r in load(spark, d, "region").select("r_regionkey", "r_name").collect())
    WR.save_upload(spark, folder, "../in/World Map.docx", _docx(rows))
    WR.save_upload(spark, folder, "broken.docx", b"no archive")
    files = RD.binary_files(spark, folder + "/*").where("route = 'docx'")
    return O.elements(O.docx_table(files)).select("docName", F.array_join("sectionPath", " > ").alias("path"), "elementType", "text", "elementId")


def upload_routes(spark, d):
    """Uploaded files by the way they go; a PDF with a text layer is told from one without."""
    folder = shared_folder(spark, "routes")
    for name, content in (("a.md", b"# x"), ("b.PNG", b"p"), ("c.pdf", b"%PDF-1.4\nstream\nBT (hi) Tj ET\nendstream"), ("d.pdf", b"%PDF-1.4\nstream\nq 1 0 0 1 cm Q\nendstream"), ("e.zzz", b"?")):
        WR.save_upload(spark, folder, name, content)
    f = RD.binary_files(spark, folder + "/*")
    return f.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "route", RD.is_real_pdf(F.col("content")).alias("pdf"), O.is_searchable_pdf(F.col("content")).alias("searchable"))


def _pages(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey")
    k = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://host.example/s/"), k)
    to = lambda n: F.concat(F.lit('<a class="x" href="/s/'), (F.col("s_suppkey") * 2 + n).cast("string"), F.lit('">next <b>one</b></a>'))
    return s.select(url.alias("url"), F.concat(F.lit("<html>"), to(1), to(2), F.lit('<a href="../f/doc'), k, F.lit('.pdf#p2">File '), k, F.lit("</a></html>")).alias("html"))


def page_links(spark, d):
    return W.links(_pages(spark, d))


def linked_documents(spark, d):
    return W.documents_of(W.links(_pages(spark, d)))


def crawl_depths(spark, d):
    """Pages reached from the first one in four steps; each links to two."""
    l = W.links(_pages(spark, d))
    seeds = l.select("url").where(F.col("url").endswith("/s/1")).distinct()
    return W.crawl(l, seeds, 4, 400)


def conll_sentences(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    word = F.replace("n_name", F.lit(" "), F.lit("_"))
    lines = n.select(F.explode(F.array(*[F.struct((F.col("n_nationkey").cast("bigint") * 3 + i).alias("n"), v.alias("value")) for i, v in enumerate((F.concat(word, F.lit(" x B-LOC")), F.lit("trades O"), F.lit(" ")))])).alias("l")).select("l.*")
    return N.sentence_islands(lines).select(F.col("sentence").cast("bigint").alias("sentence"), "n", "word", "label")


def labelled_edges(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("entity"))
    e = G.comention_edges(m)
    labels = load(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("node"))
    return RD.labelled_edges(e, labels).select("src", "dst")


def markdown_dump(spark, d):
    p = load(spark, d, "parsed_elements").where("page is not null and text is not null").groupBy("docName", "page").agg(F.min("text").alias("markdown"))
    return WR.markdown_of(p).select("docName", F.md5("markdown").alias("markdown"))


def edge_partitions(spark, d):
    """Edges by type in partitions; one type is written again, another cleared."""
    out = shared_folder(spark, "edges")
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"))
    WR.overwrite_partitions(e, out, "type")
    WR.overwrite_partitions(e.where("type = 'A'").select("src", "dst", "type").distinct(), out, "type")
    WR.clear(spark, out, "type != 'N'")
    return spark.read.parquet(out).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def partitioned_upsert(spark, d):
    """Orders by customer segment of the key; an upsert touches one partition."""
    out = shared_folder(spark, "orders")
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("part"))
    WR.merge_into(o, out, ["o_orderkey"], partition="part")
    WR.merge_into(o.where("part = 1").withColumn("status", F.lit("X")), out, ["o_orderkey"], partition="part")
    return spark.read.parquet(out).groupBy("part", "status").agg(F.count(F.lit(1)).alias("n"))


def manifest_counts(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "exists").otherwise("fail")
    return WR.status_counts(load(spark, d, "orders").select(s.alias("status")))


def evaluation_versions(spark, d):
    """Two versions of a report beside each other."""
    out = shared_folder(spark, "eval")
    rows = load(spark, d, "eval_items").select("item_id", "lang")
    WR.evaluation_report(rows, out, "1", mode="vector", k="5")
    WR.evaluation_report(rows.where("item_id % 2 = 0"), out, "2", mode="graph")
    back = spark.read.schema("item_id long, lang string").json(out + "/v*/rows").withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "/v([0-9]+)/rows", 1))
    config = spark.read.schema("version string, config map<string,string>").json(out + "/v*/config").select("version", F.col("config")["mode"].alias("mode"))
    return back.groupBy("version").agg(F.count(F.lit(1)).alias("n")).join(config, "version")


def element_ids(spark, d):
    e = load(spark, d, "parsed_elements").select("docName", C.sequence_of(F.col("elementId")).alias("n"), "elementId").distinct()
    return e.select("elementId", X.element_id(F.col("docName"), F.col("n")).alias("made"), X.chunk_id(F.col("docName"), F.col("n")).alias("chunk"))


def table_texts(spark, d):
    """Orders as tables: a header row and a row per line."""
    l = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("text"))
    body = l.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.explode(F.array(cell(0, F.col("p")), cell(1, F.col("s")))).alias("c")).select("table_id", "row", "c.col", "c.text", F.lit(False).alias("header"))
    head = l.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row"), F.explode(F.array(cell(0, F.lit("part")), cell(1, F.lit("supplier")))).alias("c")).select("table_id", "row", "c.col", "c.text", F.lit(True).alias("header"))
    return C.table_text(body.unionByName(head)).select("table_id", F.md5("text").alias("text"))


def _region_graph(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 100).cast("bigint").alias("dst"), F.when(F.col("n_nationkey") % 3 == 0, "LIES_IN").when(F.col("n_nationkey") % 3 == 1, "BELONGS_TO").otherwise("MENTIONED_IN").alias("type"))
    return n.withColumn("edge_id", F.struct("src", "dst"))


def path_types(spark, d):
    """Paths of two steps all of whose edges, and none of whose edges, have certain types."""
    e = _region_graph(spark, d)
    p = G.trail_paths(e, e.select(F.col("src").alias("node")), 2).withColumn("path_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"))
    every = G.path_filter(p, e, every=["LIES_IN", "BELONGS_TO"]).select("path_id", F.lit("all").alias("rule"))
    none = G.path_filter(p, e, none=["MENTIONED_IN", "LIES_IN"]).select("path_id", F.lit("none").alias("rule"))
    return every.unionByName(none)


def scoped_edges(spark, d):
    e = _region_graph(spark, d).withColumn("corpus", F.concat(F.lit("c"), (F.col("src") % 4).cast("string")))
    one, some, every = G.scoped(e, "c1", "corpus"), G.scoped(e, ["c1", "c2"], "corpus"), G.scoped(e, None, "corpus")
    return one.select(F.lit("one").alias("scope"), "src").unionByName(some.select(F.lit("list").alias("scope"), "src")).unionByName(every.select(F.lit("none").alias("scope"), "src"))


def explorer_expand(spark, d):
    """Nodes on show and the neighbours of one of them, each once; edges among them."""
    e = _region_graph(spark, d)
    shown = e.where("src < 3").select(F.col("src").alias("id"), F.lit("shown").alias("state"))
    more = e.where("dst = 101").select(F.col("src").alias("id"), F.lit("new").alias("state"))
    return G.expanded(shown, more.unionByName(more))


def seed_pick(spark, d):
    e = _region_graph(spark, d)
    few = G.neighbours(e).groupBy("node").agg(F.count_distinct("neighbour").alias("n")).where("n between 5 and 50")
    return G.pick(few, "node", 7)


def pending_embeddings(spark, d):
    """Documents not embedded yet get a vector; a rerun has nothing left to do."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    done = docs.where("doc_id % 3 = 0")
    v = H.embedded(H.pending(docs, done, "doc_id"), "doc_id", "text")
    return v.agg(F.count(F.lit(1)).alias("rows"), F.count("vector").alias("vectors"), F.max(F.size("vector")).alias("length"))


def chunk_lookup(spark, d):
    """The texts of cited chunks by id; unknown ids keep nulls."""
    hits = load(spark, d, "message_citations").where("chunkId is not null").select("chunkId").distinct()
    return R.lookup(hits, load(spark, d, "chunks").select("chunkId", "docName", F.md5("text").alias("text")), "chunkId")


def gazetteer_flags(spark, d):
    t = load(spark, d, "ls_import").select(F.explode(F.split("data.text", " ")).alias("w")).where("w != ''").distinct()
    f = N.flags(F.col("w"), ["Bank", "Fund", "بنك", "شركة"], ["million", "مليون", "جنيه"], ["January", "May", "يناير"])
    return t.select("w", *[c.alias(k) for k, c in f.items()]).where("is_org_trigger or in_money_trigger or in_month")


def type_map(spark, d):
    m = MQ._spans(spark, d).where("chunkId is not null").select(F.concat_ws("-", X.slug(F.col("text")), "type").alias("id"), "type", F.col("id").alias("seq"))
    return E.type_map(m)


def token_accuracy(spark, d):
    t = load(spark, d, "embeddings").select(F.col("label").alias("gold"), F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 3).when(F.col("vec_id") % 7 != 0, F.col("label")).alias("found"))
    return M.token_accuracy(t).select("tokens", F.round("accuracy", 9).alias("accuracy"))


def label_distribution(spark, d):
    return M.distribution(MQ._spans(spark, d), "type").select("label", "n", F.round("share", 9).alias("share"))


def disconnected_share(spark, d):
    """A chain of suppliers: communities of neighbours hang together, those of every third do not."""
    s = load(spark, d, "supplier").select("s_suppkey")
    e = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"), F.lit(1.0).alias("weight")).join(s.select(F.col("s_suppkey").alias("dst")), "dst", "left_semi")
    labels = s.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") < 5, F.lit(0)).otherwise(F.col("s_suppkey") % 3 + 1).cast("bigint").alias("label"))
    return CM.disconnected_share(G.adjacency(e), labels).select(F.round("disconnected", 9).alias("disconnected"))


def dense_relabel(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.lit(1000) - F.col("s_nationkey")).alias("label"))
    return CM.dense_labels(s)


def community_ids(spark, d):
    s = load(spark, d, "supplier").select(F.lit(2).alias("level"), F.col("s_nationkey").alias("label")).distinct()
    c = s.select(CM.community_id("my-corpus").alias("community"))
    return c.select("community", CM.community_of().alias("p")).select("community", "p.corpus", "p.level", "p.label")


def lookup_forms(spark, d):
    t = load(spark, d, "chunks").select("docName", F.explode("sectionPath").alias("t")).distinct()
    u = F.concat(F.lit("https://host.example/a/"), F.replace("docName", F.lit(" "), F.lit("%20")))
    return t.select("docName", "t", X.normalize_for_lookup(F.col("t")).alias("lookup"), X.embed_text(F.col("t"), F.array("docName", "t", F.lit(""))).alias("embed"), S.title_of(F.col("t")).alias("title"), X.safe_name(u).alias("file"))


def seed_entities(spark, d):
    """The entities nearest to the query among those that allowed orders mention."""
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    allowed = load(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("chunk"))
    return R.seed_entities(VQ._vectors(spark, d), VQ._query(spark, d), m, allowed, 8).select("id", F.round("score", 6).alias("score"))


def graph_search(spark, d):
    """Typed supplier-part edges with the orders that show them, searched from the query's entities; access by order priority."""
    e = load(spark, d, "lineitem").groupBy((F.col("l_suppkey") + 1_000_000_000).alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type")).agg(F.collect_set(F.col("l_orderkey")).alias("chunkIds"))
    e = e.withColumn("edge_id", F.struct("src", "dst", "type"))
    v = VQ._vectors(spark, d)
    rel = VQ._centroids(spark, d).where("id < 3").select(F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") + 1).cast("int")).alias("id"), "vector")
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    allowed = load(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("chunk"))
    return R.graph_search(e, rel, v, m, allowed, VQ._query(spark, d), seeds=8, depth=2, k=20).select("chunk", F.round("score", 6).alias("score"))


PPR_ROUNDS = 5


def ppr_retriever(spark, d):
    """Query vector to chunks: seeds, specificity, PageRank over suppliers, chunk scores and the orders' texts."""
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("entity")).distinct()
    texts = load(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_orderpriority").alias("text"))
    v = VQ._vectors(spark, d).join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    r = R.ppr_retrieve(G.adjacency(G.comention_edges(m)), m, v, texts, VQ._query(spark, d), k=20, iterations=PPR_ROUNDS, tolerance=None)
    return r.select("chunk", F.round("score", 7).alias("score"), F.size("contributors").alias("contributors"), "text")


def retrieve_dispatch(spark, d):
    """One entry for all modes; an unknown mode or clearance gives no hits."""
    v = VQ._vectors(spark, d)
    search = {"vector": lambda k, level: V.vector_search(v, VQ._query(spark, d), k).select("id", "score")}
    out = None
    for mode, level in (("vector", "internal"), ("vector", "nobody"), ("dance", "public")):
        part = R.retrieve(mode, S.REQUEST["k"], level, search, v.select("id", F.lit(0.0).alias("score"))).select(F.lit(f"{mode}/{level}").alias("request"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def merged_entities(spark, d):
    """Entities after their duplicates were merged: aliases in order, the canonical one's first."""
    return _merged(spark, d)["entities"].select("id", "name", F.array_join("aliases", "|").alias("aliases"))


def merged_edges(spark, d):
    return _merged(spark, d)["edges"].select("src", "type", "dst", "weight", F.array_join(F.transform("chunkIds", lambda x: x.cast("string")), "|").alias("chunkIds"))


def _merged(spark, d):
    e = MQ._entities(spark, d).withColumn("aliases", F.array(F.concat(F.lit("a"), (F.col("id") % 7).cast("string"))))
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_partkey") % 500).alias("entity")).distinct()
    x = load(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("src"), F.col("l_returnflag").alias("type"), (F.col("l_suppkey") % 500).alias("dst")).agg(F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_set("l_linenumber")).alias("chunkIds"))
    return A.merged(e.drop("vector"), m, x, A.canonical_map(A.clusters(A.duplicate_links(e, 0.40)), e))


def synonym_edges(spark, d):
    """Near vectors of one type, the words of one name among the other's."""
    e = VQ._vectors(spark, d).select("id", "type", "vector", F.concat(F.lit("n k"), (F.col("id") % 5).cast("string"), F.when(F.col("id") % 3 == 0, " extra").otherwise("")).alias("name"))
    return V.synonyms(e, 0.30).select("src", "dst", F.round("weight", 6).alias("weight"))


def chat_listing(spark, d):
    """The chats of some users, a page of them, the last active first."""
    c = load(spark, d, "chats")
    users = c.where("userId < '8'").select("userId")
    return S.listed(S.owned(c, users), 40, 10).select("id", "userId", "title")


def chat_lifecycle(spark, d):
    """Chats are opened, renamed and deleted; what is left."""
    c, m, x = load(spark, d, "chats"), load(spark, d, "messages"), load(spark, d, "message_citations")
    asked = load(spark, d, "eval_items").select(F.concat(F.lit("new-"), F.col("item_id").cast("string")).alias("id"), F.lit("u1").alias("userId"), "question")
    c = S.create_chats(c, asked, F.lit("2025-01-01").cast("timestamp"))
    c = S.renamed(c, c.where("id like '%a'").select("id", F.lit("renamed").alias("title")))
    t = S.deleted(c, m, x, c.where("id like 'new-%' and length(title) < 60 or id like '%b'").select("id"))
    return t["chats"].agg(F.count(F.lit(1)).alias("chats"), F.count_if(F.col("title") == "renamed").alias("renamed")).crossJoin(t["messages"].agg(F.count(F.lit(1)).alias("messages"))).crossJoin(t["citations"].agg(F.count(F.lit(1)).alias("citations")))


def memory_upsert(spark, d):
    c = load(spark, d, "chats").where("id is not null").select("id").distinct()
    old = c.where("id < 'a'").select(F.col("id").alias("chatId"), F.lit("old").alias("summary"))
    new = c.where("id > '5'").select(F.col("id").alias("chatId"), F.lit("new").alias("summary"))
    return S.remembered(old, new, ["chatId"]).groupBy("summary").agg(F.count(F.lit(1)).alias("n"))


def session_flow(spark, d):
    """Users log in and some out; only hashes are kept."""
    u = load(spark, d, "chats").where("userId is not null").select(F.col("userId").alias("id")).distinct()
    tokens = u.select(F.col("id").alias("userId"), F.concat(F.lit("t-"), "id").alias("token")).unionByName(spark.range(1).select(F.lit("nobody").alias("userId"), F.lit("x").alias("token")))
    s = S.logged_in(spark.createDataFrame([], "tokenHash string, userId string"), u, tokens)
    return S.logged_out(s, tokens.where("userId < '8'"))


def message_projection(spark, d):
    m = load(spark, d, "messages").where("id is not null").select("id", "role", "createdAt", "tokenCount").distinct()
    return S.without(S.stamps(m, "createdAt"), "tokenCount")


def question_prompts(spark, d):
    e = load(spark, d, "eval_items")
    return e.select("item_id", F.md5(S.question_prompt(F.when(F.col("item_id") % 2 == 0, F.col("paragraph_text")), F.col("question"))).alias("prompt"))


def summary_prompts(spark, d):
    e = load(spark, d, "eval_items")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return e.select("item_id", F.md5(S.summary_prompt(F.when(F.col("item_id") % 3 == 0, F.col("title")), turns)).alias("prompt"))


def routed_questions(spark, d):
    """Questions by the stand-in of the routing model."""
    from pyspark.sql.functions import pandas_udf

    route = pandas_udf(lambda q: q.fillna("").map(H.route), "string")
    return load(spark, d, "eval_items").select(route("question").alias("way")).groupBy("way").agg(F.count(F.lit(1)).alias("n"))


def sse_events(spark, d):
    """Answers as event streams: citations, words, done; through the wire form and back."""
    m = load(spark, d, "messages").where("id is not null and content is not null").groupBy("id").agg(F.min("content").alias("content")).withColumn("citations", F.array(F.struct("id")))
    return J.parsed_frames(J.event_frames(J.token_events(m))).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def document_discovery(spark, d):
    return S.discovered(MQ._spans(spark, d).where("docName is not null"), load(spark, d, "chunks"))


def trigger_filter(spark, d):
    s = MQ._spans(spark, d)
    return N.without_triggers(s.where("text is not null"), ["the Bank", "البنك"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def late_events(spark, d):
    """Hourly counts of a stream whose second file repeats all events a thousand days earlier: the watermark of two hours drops them."""
    out = shared_folder(spark, "late")
    e = load(spark, d, "events").select("ts", "event_type", "value")
    e.coalesce(1).write.parquet(out + "/in/part=1")
    stream = lambda: J.files(spark, out + "/in/*", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    run = lambda: J.windowed_counts(stream()).writeStream.format("parquet").option("path", out + "/out").option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start().awaitTermination()
    run()
    e.withColumn("ts", F.expr("ts - interval 1000 days")).coalesce(1).write.parquet(out + "/in/part=2")
    run()
    return spark.read.parquet(out + "/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("events"))


_M = MQ._SP
_MSG = "(SELECT DISTINCT id, role, createdAt, tokenCount FROM messages WHERE id IS NOT NULL)"
_PAGES = "p AS (SELECT s_suppkey AS k, 'https://host.example/s/'||s_suppkey AS url FROM supplier)"
_RG = "rg AS (SELECT n_nationkey::BIGINT AS src, (n_regionkey+100)::BIGINT AS dst, CASE n_nationkey%3 WHEN 0 THEN 'LIES_IN' WHEN 1 THEN 'BELONGS_TO' ELSE 'MENTIONED_IN' END AS type FROM nation)"
_ALLOWED = "ok AS (SELECT o_orderkey AS chunk FROM orders WHERE o_orderpriority LIKE '1%')"
_MERGE = MQ._EN + ", rr AS (SELECT cl.id, first_value(en.id) OVER (PARTITION BY cluster ORDER BY mentions DESC, length(name) DESC, en.id) AS canonical FROM cl JOIN en USING (id))"

QUERIES = {
    f.__name__: f
    for f in (
        json_dump_roundtrip, jsonl_scan, csv_graph_scan, docx_elements, upload_routes, page_links, linked_documents, crawl_depths, conll_sentences, labelled_edges, markdown_dump, edge_partitions, partitioned_upsert, manifest_counts, evaluation_versions, element_ids, table_texts,
        path_types, scoped_edges, explorer_expand, seed_pick, pending_embeddings, chunk_lookup, gazetteer_flags, type_map, token_accuracy, label_distribution, disconnected_share, dense_relabel, community_ids, lookup_forms, seed_entities, graph_search,
        ppr_retriever, retrieve_dispatch, merged_entities, merged_edges, synonym_edges, chat_listing, chat_lifecycle, memory_upsert, session_flow, message_projection, question_prompts, summary_prompts, routed_questions, sse_events, document_discovery,
        trigger_filter, late_events,
    )
}


def _ppr_sql() -> str:
    m = "m AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey AS entity FROM lineitem), co AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM m a JOIN m b ON a.chunk=b.chunk AND a.entity<b.entity GROUP BY 1,2)"
    ctes = [
        m, "adj AS (SELECT src,dst,weight FROM co UNION ALL SELECT dst,src,weight FROM co)", "deg AS (SELECT src, sum(weight) AS g FROM adj GROUP BY 1)", "t AS (SELECT adj.src, adj.dst, adj.weight/g AS p FROM adj JOIN deg USING (src))",
        f"sc AS (SELECT vec_id AS id, greatest(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]),0) AS g FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id={VQ.QUERY_ID}) q WHERE vec_id IN (SELECT s_suppkey FROM supplier) ORDER BY 2 DESC, 1 LIMIT 5)",
        "s1 AS (SELECT id AS node, g FROM sc WHERE id IN (SELECT src FROM adj)), s2 AS (SELECT node, g/count(DISTINCT chunk) AS w FROM s1 JOIN m ON m.entity=node GROUP BY node, g), s AS (SELECT node, w/(SELECT sum(w) FROM s2) AS mass FROM s2), r0 AS (SELECT node, mass AS score FROM s)",
    ]
    for i in range(1, PPR_ROUNDS + 1):
        ctes.append(f"r{i} AS (SELECT node, sum(v) AS score FROM (SELECT t.dst AS node, 0.5*t.p*r.score AS v FROM t JOIN r{i - 1} r ON t.src=r.node UNION ALL SELECT node, 0.5*mass FROM s) GROUP BY node)")
    return "WITH " + ", ".join(ctes) + f", c AS (SELECT chunk, sum(score) AS raw, least(count(*),3)::INT AS contributors FROM m JOIN r{PPR_ROUNDS} r ON m.entity=r.node WHERE score>1e-6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT chunk, round(raw,7) AS score, contributors, o_orderpriority AS text FROM c JOIN orders ON o_orderkey=chunk"


SQL = {
    "json_dump_roundtrip": "SELECT docName, count(*) AS chunks, sum(length(text))::BIGINT AS chars, sum(len(elementIds))::BIGINT AS elements FROM chunks GROUP BY 1",
    "jsonl_scan": "SELECT role, count(*) AS n, sum(length(content))::BIGINT AS chars FROM messages GROUP BY 1",
    "csv_graph_scan": "SELECT 'customer' AS what, count(*) AS n, count(DISTINCT coalesce(nullif(trim(c_mktsegment),''),'')) AS kinds FROM customer UNION ALL SELECT 'order', count(*), 1 FROM orders UNION ALL SELECT CASE WHEN o_orderkey%3=0 THEN 'placed' ELSE 'linked to' END, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 1",
    "docx_elements": "SELECT 'world_map' AS docName, 'World' AS path, 'heading' AS elementType, 'World' AS text, 'world_map-0001' AS elementId UNION ALL SELECT 'world_map','World > Regions','heading','Regions','world_map-0002' UNION ALL SELECT 'world_map','World > Regions','paragraph','All regions follow.','world_map-0003' UNION ALL SELECT 'world_map','World > Regions','table',string_agg('| '||r_regionkey||' | '||r_name||' |', chr(10) ORDER BY r_regionkey::VARCHAR),'world_map-0004' FROM region UNION ALL SELECT 'world_map','End','heading','End','world_map-0005'",
    "upload_routes": "SELECT * FROM (VALUES ('a.md','text',false,false),('b.PNG','ocr',false,false),('c.pdf','ocr',true,true),('d.pdf','ocr',true,false),('e.zzz',NULL,false,false)) t(file,route,pdf,searchable)",
    "page_links": f"WITH {_PAGES} SELECT url, 'https://host.example/s/'||(k*2+1) AS href, 'next one' AS title FROM p UNION SELECT url, 'https://host.example/s/'||(k*2+2), 'next one' FROM p UNION SELECT url, 'https://host.example/s/../f/doc'||k||'.pdf', 'File '||k FROM p",
    "linked_documents": f"WITH {_PAGES} SELECT 'https://host.example/s/../f/doc'||k||'.pdf' AS href, url AS page, 'File '||k AS title, 'doc'||k||'.pdf' AS file FROM p",
    "crawl_depths": f"WITH {_PAGES}, d0 AS (SELECT k, url FROM p WHERE k=1), d1 AS (SELECT k*2+1 AS k FROM d0 UNION SELECT k*2+2 FROM d0), d2 AS (SELECT k*2+1 AS k FROM d1 JOIN p USING (k) UNION SELECT k*2+2 FROM d1 JOIN p USING (k)), d3 AS (SELECT k*2+1 AS k FROM d2 JOIN p USING (k) UNION SELECT k*2+2 FROM d2 JOIN p USING (k)), d4 AS (SELECT k*2+1 AS k FROM d3 JOIN p USING (k) UNION SELECT k*2+2 FROM d3 JOIN p USING (k)) SELECT 'https://host.example/s/'||k AS url, min(dp)::INT AS depth FROM (SELECT k, 0 AS dp FROM d0 UNION ALL SELECT k,1 FROM d1 UNION ALL SELECT k,2 FROM d2 UNION ALL SELECT k,3 FROM d3 UNION ALL SELECT k,4 FROM d4) GROUP BY 1",
    "conll_sentences": "SELECT n_nationkey::BIGINT AS sentence, n_nationkey::BIGINT*3 AS n, replace(n_name,' ','_') AS word, 'B-LOC' AS label FROM nation UNION ALL SELECT n_nationkey, n_nationkey*3+1, 'trades', 'O' FROM nation",
    "labelled_edges": "WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS e FROM lineitem), l AS (SELECT s_suppkey AS n FROM supplier WHERE s_nationkey<12) SELECT DISTINCT a.e AS src, b.e AS dst FROM m a JOIN m b ON a.c=b.c AND a.e<b.e WHERE a.e IN (SELECT n FROM l) AND b.e IN (SELECT n FROM l)",
    "markdown_dump": "WITH p AS (SELECT docName, page, min(text) AS t FROM parsed_elements WHERE page IS NOT NULL AND text IS NOT NULL GROUP BY 1,2) SELECT docName, md5(string_agg(t, chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY page)) AS markdown FROM p GROUP BY 1",
    "edge_partitions": "SELECT 'A' AS type, count(DISTINCT (l_suppkey,l_partkey)) AS n FROM lineitem WHERE l_returnflag='A' UNION ALL SELECT l_returnflag, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A','N') GROUP BY 1",
    "partitioned_upsert": "SELECT (o_orderkey%4)::INT AS part, CASE WHEN o_orderkey%4=1 THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1,2",
    "manifest_counts": "SELECT count(*) FILTER (WHERE o_orderstatus='F') AS ok, count(*) FILTER (WHERE o_orderstatus='O') AS exists, count(*) FILTER (WHERE o_orderstatus NOT IN ('F','O')) AS fail FROM orders",
    "evaluation_versions": "SELECT '1' AS version, count(*) AS n, 'vector' AS mode FROM eval_items UNION ALL SELECT '2', count(*) FILTER (WHERE item_id%2=0), 'graph' FROM eval_items",
    "element_ids": "WITH e AS (SELECT DISTINCT docName, nullif(regexp_extract(elementId,'([0-9]{1,18})$',1),'')::BIGINT AS n, elementId FROM parsed_elements) SELECT elementId, printf('%s-%04d',docName,n) AS made, printf('%s-c%04d',docName,n) AS chunk FROM e",
    "table_texts": "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS r, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1,2), c AS (SELECT k, max(r) AS e FROM l GROUP BY 1) SELECT k AS table_id, md5(CASE WHEN e>1 THEN string_agg('part: '||p||', supplier: '||s, chr(10) ORDER BY r) ELSE 'part: supplier, '||string_agg(p||': '||s, ', ' ORDER BY r) END) AS text FROM l JOIN c USING (k) GROUP BY k, e",
    "path_types": f"WITH {_RG}, step AS (SELECT src, dst, type, src||'-'||dst AS e FROM rg UNION ALL SELECT dst, src, type, src||'-'||dst FROM rg), p AS (SELECT src||'>'||dst AS path_id, [type] AS ts FROM step WHERE src IN (SELECT src FROM rg) UNION ALL SELECT a.src||'>'||a.dst||'>'||b.dst, [a.type,b.type] FROM step a JOIN step b ON a.dst=b.src AND a.e<>b.e WHERE a.src IN (SELECT src FROM rg)) SELECT path_id, 'all' AS rule FROM p WHERE NOT list_contains(ts,'MENTIONED_IN') UNION ALL SELECT path_id, 'none' FROM p WHERE NOT list_has_any(ts,['MENTIONED_IN','LIES_IN'])",
    "scoped_edges": f"WITH {_RG} SELECT 'one' AS scope, src FROM rg WHERE src%4=1 UNION ALL SELECT 'list', src FROM rg WHERE src%4 IN (1,2) UNION ALL SELECT 'none', src FROM rg",
    "explorer_expand": f"WITH {_RG} SELECT src AS id, 'shown' AS state FROM rg WHERE src<3 UNION ALL SELECT src, 'new' FROM rg WHERE dst=101 AND src>=3",
    "seed_pick": f"WITH {_RG}, n AS (SELECT dst AS node FROM rg GROUP BY 1 HAVING count(DISTINCT src) BETWEEN 5 AND 50) SELECT node FROM n ORDER BY md5('7:'||node), node LIMIT 1",
    "pending_embeddings": "SELECT count(*) AS rows, count(*) AS vectors, 64::INT AS length FROM documents WHERE doc_id%3<>0",
    "chunk_lookup": "WITH h AS (SELECT DISTINCT chunkId FROM message_citations WHERE chunkId IS NOT NULL), t AS (SELECT chunkId, min({d:docName, t:md5(text)}) AS m FROM chunks GROUP BY 1) SELECT h.chunkId, m.d AS docName, m.t AS text FROM h LEFT JOIN t USING (chunkId)",
    "gazetteer_flags": "WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(data.text,' ')) AS w FROM ls_import) WHERE w<>'') SELECT w, w IN ('Bank','Fund','بنك','شركة') AS is_org_trigger, w IN ('million','مليون','جنيه') AS in_money_trigger, w IN ('January','May','يناير') AS in_month FROM w WHERE w IN ('Bank','Fund','بنك','شركة','million','مليون','جنيه','January','May','يناير')",
    "type_map": f"WITH {_M}, m AS (SELECT concat_ws('-', lower(regexp_replace(regexp_replace(text,'^\\s+|\\s+$','','g'),'\\s+','-','g')), type) AS i, type, id AS seq FROM sp WHERE chunkId IS NOT NULL), a AS (SELECT i AS id, arg_max(type,seq) AS type FROM m GROUP BY 1), b AS (SELECT regexp_replace(i,'-[^-]*$','') AS id, arg_min(type,seq) AS type FROM m GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)",
    "token_accuracy": "SELECT count(*) AS tokens, round(avg(coalesce(label = CASE WHEN vec_id%5=0 THEN (label+1)%3 WHEN vec_id%7<>0 THEN label END, false)::INT),9) AS accuracy FROM embeddings",
    "label_distribution": f"WITH {_M} SELECT type AS label, count(*) AS n, round(count(*)/(SELECT count(*) FROM sp),9) AS share FROM sp GROUP BY 1",
    "disconnected_share": "WITH l AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey<5 THEN 0 ELSE s_suppkey%3+1 END AS l FROM supplier), c AS (SELECT l, max(n)-min(n)+1 > count(*) AS apart FROM l GROUP BY 1) SELECT round(avg(apart::INT),9) AS disconnected FROM c",
    "dense_relabel": "WITH f AS (SELECT s_nationkey AS k, min(s_suppkey) AS f FROM supplier GROUP BY 1), r AS (SELECT k, row_number() OVER (ORDER BY f)-1 AS label FROM f) SELECT s_suppkey AS node, label FROM supplier JOIN r ON k=s_nationkey",
    "community_ids": "SELECT DISTINCT 'my-corpus-L2-c'||s_nationkey AS community, 'my-corpus' AS corpus, 2::INT AS level, s_nationkey::VARCHAR AS label FROM supplier",
    "lookup_forms": "WITH t AS (SELECT DISTINCT docName, unnest(sectionPath) AS t FROM chunks) SELECT docName, t, translate(regexp_replace(t,'[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}]','','g'),'أإآى','اااي') AS lookup, array_to_string(CASE WHEN t=docName THEN [t] ELSE [t,docName] END,' / ') AS embed, substr(trim(t),1,60) AS title, regexp_replace(docName,'[^A-Za-z0-9_.\\-\\x{0600}-\\x{06FF}]+','_','g') AS file FROM t",
    "seed_entities": f"{VQ._Q}, {_ALLOWED}, en AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT chunk FROM ok)) SELECT id, round(score,6) AS score FROM s WHERE id IN (SELECT id FROM en) ORDER BY s.score DESC, id LIMIT 8",
    "ppr_retriever": _ppr_sql(),
    "retrieve_dispatch": f"{VQ._Q} SELECT 'vector/internal' AS request, id FROM s ORDER BY s.score DESC, id LIMIT 5",
    "merged_entities": f"WITH RECURSIVE {_MERGE}, g AS (SELECT canonical, list_sort(list_distinct(flatten(list([name,'a'||(rr.id%7)])))) AS n FROM rr JOIN en ON en.id=rr.id WHERE rr.id<>canonical GROUP BY 1) SELECT en.id, name, array_to_string(list_filter(list_concat(['a'||(en.id%7)], list_filter(coalesce(n,[]), lambda x: x<>'a'||(en.id%7))), lambda x: x<>name),'|') AS aliases FROM en LEFT JOIN g ON canonical=en.id WHERE en.id NOT IN (SELECT id FROM rr WHERE id<>canonical)",
    "merged_edges": f"WITH RECURSIVE {_MERGE}, x AS (SELECT l_partkey%500 AS src, l_returnflag AS type, l_suppkey%500 AS dst, l_linenumber AS c FROM lineitem WHERE l_partkey%500<>l_suppkey%500), y AS (SELECT coalesce(a.canonical,src) AS src, type, coalesce(b.canonical,dst) AS dst, c FROM x LEFT JOIN rr a ON a.id=src LEFT JOIN rr b ON b.id=dst) SELECT src, type, dst, count(*) AS weight, array_to_string(list_sort(list(DISTINCT c)),'|') AS chunkIds FROM y WHERE src<>dst GROUP BY 1,2,3",
    "synonym_edges": "WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, ['n','k'||(vec_id%5)]||(CASE WHEN vec_id%3=0 THEN ['extra'] ELSE [] END) AS w FROM embeddings) SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v,b.v),6) AS weight FROM e a JOIN e b ON a.label=b.label AND a.id<b.id WHERE list_cosine_similarity(a.v,b.v)>=0.30 AND (list_has_all(a.w,b.w) OR list_has_all(b.w,a.w))",
    "chat_listing": "SELECT id, userId, title FROM (SELECT DISTINCT * FROM chats WHERE userId<'8') ORDER BY updatedAt DESC NULLS LAST, id LIMIT 40 OFFSET 10",
    "chat_lifecycle": "WITH c AS (SELECT id, CASE WHEN id LIKE '%a' THEN 'renamed' ELSE title END AS title FROM chats UNION ALL SELECT 'new-'||item_id, substr(trim(question),1,60) FROM eval_items), g AS (SELECT id FROM c WHERE id LIKE 'new-%' AND length(title)<60 OR id LIKE '%b'), k AS (SELECT * FROM c WHERE id IS NULL OR id NOT IN (SELECT id FROM g)) SELECT (SELECT count(*) FROM k) AS chats, (SELECT count(*) FROM k WHERE title='renamed') AS renamed, (SELECT count(*) FROM messages WHERE chatId IS NULL OR chatId NOT IN (SELECT id FROM g)) AS messages, (SELECT count(*) FROM message_citations WHERE messageId IS NULL OR messageId NOT IN (SELECT id FROM messages WHERE id IS NOT NULL AND chatId IN (SELECT id FROM g))) AS citations",
    "memory_upsert": "WITH c AS (SELECT DISTINCT id FROM chats WHERE id IS NOT NULL) SELECT CASE WHEN id>'5' THEN 'new' ELSE 'old' END AS summary, count(*) AS n FROM c WHERE id>'5' OR id<'a' GROUP BY 1",
    "session_flow": "SELECT DISTINCT sha256('t-'||userId) AS tokenHash, userId FROM chats WHERE userId>='8'",
    "message_projection": f"SELECT id, role, strftime(createdAt,'%Y-%m-%dT%H:%M:%S') AS createdAt FROM {_MSG}",
    "question_prompts": "SELECT item_id, md5(CASE WHEN item_id%2=0 AND trim(coalesce(paragraph_text,''))<>'' THEN 'Context:'||chr(10)||paragraph_text||chr(10)||chr(10) ELSE '' END||'Question: '||question) AS prompt FROM eval_items",
    "summary_prompts": "SELECT item_id, md5(CASE WHEN item_id%3=0 AND trim(coalesce(title,''))<>'' THEN 'Summary so far:'||chr(10)||title||chr(10)||chr(10) ELSE '' END||'New messages:'||chr(10)||'user: '||question||chr(10)||'assistant: '||answer) AS prompt FROM eval_items",
    "routed_questions": "SELECT CASE WHEN regexp_matches(coalesce(question,''),'(?i)\\b(overall|themes?|summar\\w+|across|main|trends?)\\b|ملخص|بشكل عام|أهم') THEN 'global' ELSE 'local' END AS way, count(*) AS n FROM eval_items GROUP BY 1",
    "sse_events": "WITH m AS (SELECT id, min(content) AS c FROM messages WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY 1), t AS (SELECT len(list_filter(string_split(c,' '), lambda x: x<>'')) AS k FROM m) SELECT 'citations' AS type, count(*) AS n, 0::INT AS first FROM t UNION ALL SELECT 'token', sum(k)::BIGINT, 1 FROM t UNION ALL SELECT 'done', count(*), min(k+1)::INT FROM t",
    "document_discovery": f"WITH {_M} SELECT DISTINCT docName FROM sp WHERE docName IN (SELECT docName FROM chunks)",
    "trigger_filter": f"WITH {_M} SELECT type, count(*) AS n FROM sp WHERE text IS NOT NULL AND text NOT IN ('the Bank','البنك') GROUP BY 1",
    "late_events": "WITH x AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events), h AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY 1,2) SELECT event_type, count(*) AS windows, sum(n)::BIGINT AS events FROM h, x WHERE s + INTERVAL 1 HOUR <= w GROUP BY 1",
}
