"""Links of crawled pages and breadth-first harvests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.runtime import cut


def absolute(base, href):
    """``href`` seen from the page ``base``."""
    root = F.regexp_extract(base, "^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", "")
    return F.when(href.rlike("^[a-z]+:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, href))


def links(pages: DataFrame) -> DataFrame:
    """Distinct ``url, href, title`` of the anchors of pages ``url, html``, without fragments."""
    a = pages.select("url", F.explode_outer(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"'#][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))).alias("a")).where("a is not null")
    href = F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return a.select("url", X.without_fragment(absolute(F.col("url"), href)).alias("href"), title.alias("title")).distinct()


def documents_of(l: DataFrame) -> DataFrame:
    """Linked files, one row each, with the first title and page, and a safe file name."""
    d = l.where(X.is_pdf(F.col("href"))).groupBy("href").agg(F.min(F.struct("url", "title")).alias("m"))
    name = F.substring_index(F.col("href"), "?", 1)
    return d.select("href", F.col("m.url").alias("page"), F.coalesce(F.nullif("m.title", F.lit("")), F.regexp_extract("href", "([^/]*)$", 1)).alias("title"), X.safe_name(name).alias("file"))


def crawl(l: DataFrame, seeds: DataFrame, depth: int, most: int = 400) -> DataFrame:
    """``url, depth`` reached from the seeds over page links: the frontier joins the links, visited pages are left out.

    The next page of a paginated listing costs no depth. At most ``most`` pages
    (the politeness limit of a crawl) are kept, the shallow ones first.
    """
    pages = l.where(~X.is_pdf(F.col("href"))).select("url", F.col("href").alias("to"))
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for _ in range(depth + most):
        step = frontier.join(pages, "url").select(F.col("to").alias("url"), (F.col("depth") + F.when(X.next_page(F.col("url")) == F.col("to"), 0).otherwise(1)).alias("depth")).where(F.col("depth") <= depth)
        frontier = cut(step.groupBy("url").agg(F.min("depth").alias("depth")).join(seen, "url", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.orderBy("depth", "url").limit(most)
