"""Word-processor files and the test whether a PDF holds text, without other libraries."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ITEMS = "path string, n int, kind string, level int, text string, cells array<array<string>>"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()


def docx_items(content: bytes) -> list[tuple[str, int, str, list[list[str]] | None]]:
    """``(kind, level, text, cells)`` of the body in order: headings, list items, paragraphs and tables; empty ones are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, int, str, list[list[str]] | None]] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            cells = [[_text(c) for c in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            out.append(("table", 0, "\n".join("| " + " | ".join(r) + " |" for r in cells), cells))
        elif node.tag == f"{_W}p" and (t := _text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else style.get(f"{_W}val", "")
            level = re.search(r"(?i)heading\s*([0-9])", name)
            kind = "heading" if level else "list" if node.find(f"{_W}pPr/{_W}numPr") is not None or "list" in name.lower() else "paragraph"
            out.append((kind, int(level.group(1)) if level else 0, t, None))
    return out


def docx_table(files: DataFrame) -> DataFrame:
    """``path, n, kind, level, text, cells`` of files ``path, content``; a file that cannot be read gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows += [(p, n, *x) for n, x in enumerate(docx_items(bytes(c)), 1)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "n", "kind", "level", "text", "cells"])

    return files.select("path", "content").mapInPandas(run, ITEMS)


def elements(items: DataFrame) -> DataFrame:
    """Items as parsed elements ``docName, sectionPath, elementType, text, elementId``: the path is the stack of headings above.

    The stack is a fold over the items of one file, as for marked-up text.
    """
    fold = """aggregate(x, named_struct('p', cast(array() as array<string>), 'out', cast(array() as array<struct<n: int, path: array<string>>>)), (a, i) -> named_struct(
        'p', case when i.kind = 'heading' then array_append(slice(a.p, 1, least(size(a.p), greatest(i.level - 1, 0))), i.text) else a.p end,
        'out', array_append(a.out, named_struct('n', i.n, 'path', case when i.kind = 'heading' then array_append(slice(a.p, 1, least(size(a.p), greatest(i.level - 1, 0))), i.text) else a.p end))), a -> a.out)"""
    g = items.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "level", "text"))).alias("x"))
    paths = g.select("path", F.explode(F.expr(fold)).alias("p")).select("path", "p.n", F.col("p.path").alias("sectionPath"))
    doc = F.lower(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))
    return items.join(paths, ["path", "n"]).select(doc.alias("docName"), "sectionPath", F.col("kind").alias("elementType"), "text", F.format_string("%s-%04d", doc, "n").alias("elementId"))


@F.pandas_udf(T.BooleanType())
def has_text_layer(content: pd.Series) -> pd.Series:
    """Does a PDF show text itself (else its pages are pictures)? Streams are inflated and searched for operators that show text."""

    def one(c) -> bool:
        if c is None or not bytes(c).startswith(b"%PDF"):
            return False
        for s in re.findall(rb"stream\r?\n(.*?)endstream", bytes(c), flags=re.S):
            try:
                s = zlib.decompressobj().decompress(s)
            except zlib.error:
                pass
            if re.search(rb"BT\b.*?(?:Tj|TJ)\b", s, flags=re.S):
                return True
        return False

    return content.map(one)


def is_searchable_pdf(content: Column) -> Column:
    return has_text_layer(content)
