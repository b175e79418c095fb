"""Readers of the file formats that feed the pipeline; schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "array<struct<page: int, markdown: string>>"
ELEMENT = "docName string, sectionPath array<string>, page int, elementType string, text string, elementId string, accessLevel string"
CHUNK = "chunkId string, docName string, sectionPath array<string>, pages array<int>, text string, elementIds array<string>, accessLevel string"
EXTRACTION = "chunkId string, entities array<struct<canonicalId: string, canonicalName: string, type: string, aliases: array<string>>>, relationships array<struct<subject: string, predicate: string, object: string>>"
QUESTION = "id string, question string, answer string, paragraphs array<struct<title: string, paragraph_text: string, is_supporting: boolean>>"
TASK = "data struct<text: string>, meta struct<chunkId: string, docName: string>, predictions array<struct<model_version: string, result array<struct<id: string, from_name: string, to_name: string, type: string, value: struct<start: int, end: int, text: string, labels: array<string>>>>>>".replace("result array", "result: array")

# Which way a file goes by its ending.
ROUTES = {"ocr": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "pdf"), "docx": ("docx",), "text": ("md", "txt")}


def json_arrays(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON array per file; ``file`` is the file's name without ending."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines; the first ``limit`` ones in file order if given."""
    df = spark.read.schema(schema).json(path)
    return df if limit is None else df.limit(limit)


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``questions`` with their number of hops (before the id's first ``_``), and distinct ``paragraphs`` by content."""
    q = json_lines(spark, path, QUESTION)
    p = q.select("id", F.explode("paragraphs").alias("p")).select(F.concat(F.lit("text-"), F.substring(F.sha1("p.paragraph_text"), 1, 16)).alias("chunkId"), "p.title", F.col("p.paragraph_text").alias("text"))
    return q.select("id", "question", "answer", F.substring_index("id", "_", 1).alias("hop")), p.groupBy("chunkId").agg(F.min_by("title", "title").alias("title"), F.first("text").alias("text"))


def _first(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that exist."""
    have = [F.nullif(F.trim(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def graph_nodes(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Node tables (type -> path of a CSV with header) as ``id, name, jurisdiction, type``; rows without an id drop out."""
    out = None
    for kind, path in files.items():
        t = spark.read.option("header", True).csv(path)
        key = _first(t, "node_id", "id")
        part = t.select(key.alias("id"), F.coalesce(_first(t, "name", "address"), key).alias("name"), F.coalesce(_first(t, "jurisdiction_description", "countries"), F.lit("")).alias("jurisdiction"), F.lit(kind).alias("type")).where("id is not null")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no node file is given")
    return out


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge table of a CSV as ``src, dst, link``; rows that miss an end drop out."""
    t = spark.read.option("header", True).csv(path)
    return t.select(_first(t, "node_id_start", "START_ID").alias("src"), _first(t, "node_id_end", "END_ID").alias("dst"), F.coalesce(_first(t, "link", "rel_type"), F.lit("linked to")).alias("link")).where("src is not null and dst is not null")


def labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with two labelled, different ends."""
    n = labels.select(F.col("node").alias("_n")).distinct()
    return edges.where("src != dst").join(n, F.col("src") == F.col("_n"), "left_semi").join(n, F.col("dst") == F.col("_n"), "left_semi")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, value``: the lines of one text file, numbered in file order."""
    return spark.read.text(path).withColumn("n", F.monotonically_increasing_id())


def binary_files(spark: SparkSession, glob: str) -> DataFrame:
    """``path, content, route``: files by ending; an unknown ending has no route."""
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    route = F.lit(None).cast("string")
    for name, ends in ROUTES.items():
        route = F.when(end.isin(*ends), name).otherwise(route)
    return spark.read.format("binaryFile").load(glob).select("path", "content", route.alias("route"))


def recognised(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, page, markdown``: pages from a recognition hook; a file that fails gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    out += [(p, i, t) for i, t in enumerate(pages_of(bytes(c)), 1)]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["path", "page", "markdown"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, markdown string")


def plain_pages(files: DataFrame) -> DataFrame:
    """Text files as a single page each."""
    return files.where("route = 'text'").select("path", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("markdown"))


def is_real_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
