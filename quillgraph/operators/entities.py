"""Canonical entities, typed relationships and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X

# Which types a relationship may join.
RELATIONS = {
    "ISSUED_BY": (["License", "Document"], ["RegulatoryBody", "Person"]),
    "GOVERNS": (["Law", "Article"], ["BankingInstitution"]),
    "AMENDS": (["Law"], ["Law"]),
    "SUPERSEDES": (["Law"], ["Law"]),
    "PART_OF": (["Article"], ["Law"]),
    "REQUIRES": (["Law", "Article"], ["RegulatoryRequirement"]),
    "SIGNED_BY": (["Document", "License"], ["Person"]),
    "EFFECTIVE_FROM": (["Law", "License"], ["Date"]),
    "APPLIES_TO": (["Law", "Article"], ["BankingInstitution"]),
}
# Entity types.
TYPES = ("Person", "BankingInstitution", "RegulatoryBody", "Law", "Article", "License", "Document", "FinancialInstrument", "RegulatoryRequirement", "MonetaryAmount", "Date")


def canonical_global(spans: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """One entity per (normalised surface, type) over all documents.

    ``spans`` has ``seq`` (arrival order), ``text``, ``type``, ``chunkId``. The
    first surface names the entity, other surfaces are aliases in order of
    arrival; types outside ``types`` drop out.
    """
    s = spans.where(F.col("type").isin(list(types)) & F.col("text").isNotNull()).withColumn("norm", X.normalize_arabic(F.col("text")))
    forms = s.groupBy("norm", "type", "text").agg(F.min("seq").alias("seq"), F.collect_set("chunkId").alias("c"))
    g = forms.groupBy("norm", "type").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("chunkIds"))
    names = F.transform("f", lambda x: x["text"])
    return g.select(F.concat_ws("-", X.slug(F.col("norm")), "type").alias("canonicalId"), F.get(names, F.lit(0)).alias("canonicalName"), "type", F.expr("transform(slice(f, 2, size(f)), x -> x.text)").alias("aliases"), "chunkIds")


def canonical_in_doc(spans: DataFrame) -> DataFrame:
    """One entity per (document, lower-cased surface, type); aliases and chunks sorted."""
    s = spans.where("text is not null").withColumn("k", X.canonical_key(F.col("text")))
    g = s.groupBy("docName", "k", "type").agg(F.min_by("text", "seq").alias("canonicalName"), F.collect_set("text").alias("t"), F.sort_array(F.collect_set("chunkId")).alias("chunkIds"))
    return g.select(F.concat_ws("-", "docName", X.slug(F.col("k")), "type").alias("canonicalId"), "canonicalName", "type", F.sort_array(F.array_remove("t", F.col("canonicalName"))).alias("aliases"), "chunkIds", "docName")


def normal_predicate(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("-"), F.lit("_")))


def relation_rules() -> Column:
    """The rules as an array of structs ``p, s, o``: a handful of fixed rows."""
    return F.array(*[F.struct(F.lit(p).alias("p"), F.array(*[F.lit(x) for x in s]).alias("s"), F.array(*[F.lit(x) for x in o]).alias("o")) for p, (s, o) in RELATIONS.items()])


def valid_relations(relations: DataFrame, types: DataFrame) -> DataFrame:
    """``subject, predicate, object`` rows whose predicate is known and whose ends have allowed types.

    ``types`` maps unique ``id`` to ``type``; unknown or empty ends drop out.
    """
    r = relations.withColumn("predicate", normal_predicate(F.col("predicate"))).where("subject != '' and object != ''")
    t = types.select("id", "type")
    typed = r.join(t.select(F.col("id").alias("subject"), F.col("type").alias("st")), "subject").join(t.select(F.col("id").alias("object"), F.col("type").alias("ot")), "object")
    ok = F.exists(relation_rules(), lambda x: (x["p"] == F.col("predicate")) & F.array_contains(x["s"], F.col("st")) & F.array_contains(x["o"], F.col("ot")))
    return typed.where(ok).drop("st", "ot")


def type_map(mentions: DataFrame) -> DataFrame:
    """Last type per id, and first type per name-only key (the id without its last ``-part``) where no id is called so."""
    by_id = mentions.groupBy("id").agg(F.max_by("type", "seq").alias("type"))
    short = mentions.withColumn("id", F.regexp_replace("id", "-[^-]*$", "")).groupBy("id").agg(F.min_by("type", "seq").alias("type"))
    return by_id.unionByName(short.join(by_id, "id", "left_anti"))


def triple_edges(triples: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open triples looked up by lower-cased surface: directed edges, and one row of drop counters.

    ``entities`` maps unique lower-cased ``surface`` to ``id``.
    """
    e = entities.select("surface", "id")
    j = (
        triples.withColumns({"s": F.lower(F.trim("subject")), "o": F.lower(F.trim("object"))})
        .join(e.select(F.col("surface").alias("s"), F.col("id").alias("src")), "s", "left")
        .join(e.select(F.col("surface").alias("o"), F.col("id").alias("dst")), "o", "left")
    )
    unmatched, loop = F.col("src").isNull() | F.col("dst").isNull(), F.col("src") == F.col("dst")
    counters = j.agg(F.count(F.lit(1)).alias("raw"), F.count_if(unmatched).alias("unmatched"), F.count_if(F.coalesce(loop, F.lit(False))).alias("self_ref"))
    edges = j.where(~unmatched & ~loop).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_set("predicate")).alias("predicates"))
    return edges, counters


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], prefer_new: bool = True) -> DataFrame:
    """Rows of both tables, one per key: the new row wins, or (insert if absent) the existing one."""
    a, b = (new, existing) if prefer_new else (existing, new)
    return a.unionByName(b.join(a.select(keys).distinct(), keys, "left_anti"))


def merge_aliases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Entity upsert: first name and type stay, aliases become an ordered union, chunks too."""
    both = existing.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    s = both.groupBy("canonicalId").agg(F.array_sort(F.collect_list(F.struct("o", "canonicalName", "type", "aliases", "chunkIds"))).alias("v"))
    union = lambda f: F.array_distinct(F.flatten(F.transform("v", lambda x: x[f])))
    return s.select("canonicalId", F.expr("v[0].canonicalName").alias("canonicalName"), F.expr("v[0].type").alias("type"), union("aliases").alias("aliases"), union("chunkIds").alias("chunkIds"))


def prepend_aliases(existing: Column, new: Column) -> Column:
    """New aliases not yet known, in front of the known ones."""
    return F.concat(F.array_except(new, existing), existing)


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed edges, one per (src, predicate, dst) with the union of their chunks; both ends must exist."""
    n = nodes.select(F.col("id").alias("_n")).distinct()
    e = edges.join(n, F.col("src") == F.col("_n"), "left_semi").join(n, F.col("dst") == F.col("_n"), "left_semi")
    return e.groupBy("src", "predicate", "dst").agg(F.sort_array(F.collect_set("chunk")).alias("chunkIds"))


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the ids, and edges that touch none of them."""
    i = ids.select(F.col("id").alias("_d")).distinct()
    return nodes.join(i, F.col("id") == F.col("_d"), "left_anti"), edges.join(i, F.col("src") == F.col("_d"), "left_anti").join(i, F.col("dst") == F.col("_d"), "left_anti")
