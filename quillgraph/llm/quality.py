"""Per-document text statistics and what is not prose (problem 10).

Lines are exploded, measured with built-in expressions and summed per document
(partial sums before the shuffle). A document's language follows from its script
and function words. Per language, the mean and covariance of prose are
estimated robustly over the documents that stand mostly in running text, so
that the share of the others has no weight: a start by medians and median
deviations, then concentration steps that keep the documents nearest to the
current centre. A document's squared Mahalanobis distance splits into one
contribution per statistic. The distance alone decides which documents are
listed; the shares of its lines then name the form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import languages as L
from quillgraph.runtime import cut

#: The statistics that the distance is taken over.
STATS = ["log_words", "mean_word_len", "symbol_ratio", "digit_ratio", "line_end_share", "log_line_words", "common_share", "distinct_share", "plain_share"]
#: Least deviation of each statistic: prose may hold short lists and tables, be short or long, and wrap its lines anywhere.
LEAST = {"log_words": 0.7, "mean_word_len": 0.4, "symbol_ratio": 0.02, "digit_ratio": 0.02, "line_end_share": 0.25, "log_line_words": 0.6, "common_share": 0.04, "distinct_share": 0.08, "plain_share": 0.1}
#: Share of documents that a concentration step keeps; squared distance beyond which a document is an outlier (one in 10,000 of a normal sample, nine degrees of freedom).
KEEP, CUT = 0.75, 33.7
#: Least share of characters in running text of the documents that the model of prose is made from.
PROSE = 0.5
#: What parts the columns of a table; closing marks, and the end of a sentence before any of them.
GAP = r"\t|\||;(?=\S)|\S {3,}(?=\S)"
CLOSING = r"[\"')\]»\u201d]"
END = rf"[.!?:؟۔\u2026]{CLOSING}*$"


def _taken(c: Column, pattern: str) -> Column:
    """Characters in runs of ``pattern``; unlike ``regexp_count`` it makes no array of the matches."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def _gapped(line: Column) -> Column:
    """Whether ``GAP`` can match at all."""
    return line.contains("\t") | line.contains("|") | line.contains(";") | line.contains("   ")


def _ended(line: Column) -> Column:
    """Whether the line ends as ``END`` says: read from its last characters, and from all of it where these are nothing but closing marks."""
    tail = F.substring(line, -16, 16)
    return tail.rlike(END) | (tail.rlike(rf"^{CLOSING}*$") & line.rlike(END))


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per key with its figures; a null text counts as empty.

    Rows with one key are measured together as one document. ``plain_share`` is
    the share of characters in lines that read as running text, ``table_share``
    in rows of at least three columns, ``short_share`` in other short lines,
    ``odd_share`` in the rest.
    """
    lines = docs.select(F.col(key).alias("key"), F.explode_outer(F.split(F.coalesce(text, F.lit("")), "\n")).alias("raw")).select("key", F.trim("raw").alias("line")).where("length(line) > 0")
    lines = lines.select(
        "key", "line",
        F.length("line").alias("chars"),
        F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)).alias("w"),
        F.regexp_replace("line", r"[\p{L}\p{M}\s]+", "").alias("rest"),
    )
    # most words are no function words: each language is only looked for among those that are
    lines = lines.withColumn("said", L.function_words(F.col("w"))).select(
        "key", "line", "chars", "said",
        F.size("w").alias("words"),
        F.size(F.array_distinct("w")).alias("kinds"),
        F.length(F.array_join("w", "")).alias("letters"),
        L.hits(F.col("said"), "en").alias("en"), L.hits(F.col("said"), "ar").alias("ar"),
        _taken(F.col("rest"), r"[0-9٠-٩]+").alias("digits"),
        F.length(F.regexp_replace("rest", r"\p{N}+", "")).alias("symbols"),
        F.when(F.octet_length("line") == F.col("chars"), 0).otherwise(_taken(F.col("line"), r"[؀-ۿ]+")).alias("arabic"),
        F.when(_gapped(F.col("line")), F.regexp_count("line", F.lit(GAP))).otherwise(0).alias("gaps"),
        _ended(F.col("line")).cast("int").alias("ended"),
        F.col("line").rlike(r"^([-*+\u2022\u25a1\u2013\u2014\u25e6\u25aa·\u2013]|[(]?[0-9٠-٩]+[.)]|[(]?\p{L}[.)])\s").cast("int").alias("marked"),
    )
    # other languages are only looked for in lines that have hardly any English or Arabic function words
    known = F.col("en") + F.col("ar")
    lines = lines.withColumns({k: F.when(known * 10 < F.col("words"), L.hits(F.col("said"), k)).otherwise(0) for k in L.LATIN}).withColumn("common", F.greatest(known, *L.LATIN))
    commas = F.when((F.col("digits") >= 2) & F.col("line").rlike(r"^[^,]*(,[^,\s]*\d[^,\s]*){2,}$"), 2).otherwise(0)
    lines = lines.withColumn("table", (F.col("gaps") + commas) >= 2)
    # a row of a table has few function words; running text with a wide gap keeps its own
    share = F.col("common") / F.greatest("words", F.lit(1))
    arabic = F.col("line").rlike(r"[\u0621-\u064a]")
    plain = ~F.col("table") & (F.col("marked") == 0) & F.when(F.col("words") > 15, (share >= 0.12) | ((share >= 0.05) & arabic)).otherwise((share >= 0.1) | ((F.col("common") >= 1) & (F.col("words") >= 6)))
    lines = lines.withColumn("plain", plain)
    lines = lines.withColumn("shorted", ~F.col("table") & ~F.col("plain") & (F.col("words") <= 12) & ~F.col("line").rlike(r"\S{31}"))
    chars = lambda c: F.sum(F.when(F.col(c), F.col("chars")).otherwise(0))
    g = lines.groupBy("key").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.sum("letters").alias("letters"), F.sum("common").alias("common"), F.sum("kinds").alias("kinds"),
        F.sum("digits").alias("digits"), F.sum("symbols").alias("symbols"), F.sum("ended").alias("ended"), F.sum("marked").alias("marked"),
        chars("table").alias("t"), F.sum(F.col("table").cast("int")).alias("rows"), chars("plain").alias("p"), chars("shorted").alias("s"), F.sum(F.col("shorted").cast("int")).alias("entries"),
        F.approx_count_distinct("line", 0.02).alias("different"), F.sum("arabic").alias("arabic"),
        *[F.sum(k).alias(k) for k in ("en", *L.LATIN)],
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    spoken = L.most_spoken({k: F.col(k) for k in ("en", *L.LATIN)}, F.col("words"))
    stats = g.select(
        F.col("key").alias(key),
        F.when(F.col("arabic") * 2 > F.col("letters"), "ar").otherwise(spoken).alias("language"),
        F.col("lines"), F.col("words"), F.col("rows"), F.col("entries"), F.col("marked"),
        F.log1p("words").alias("log_words"),
        per("letters", "words").alias("mean_word_len"),
        per("symbols", "chars").alias("symbol_ratio"),
        per("digits", "chars").alias("digit_ratio"),
        per("ended", "lines").alias("line_end_share"),
        F.log1p(per("words", "lines")).alias("log_line_words"),
        per("common", "words").alias("common_share"),
        per("kinds", "words").alias("distinct_share"),
        per("different", "lines").alias("line_variety"),
        per("p", "chars").alias("plain_share"),
        per("t", "chars").alias("table_share"),
        per("s", "chars").alias("short_share"),
    )
    return stats


def _start(stats: DataFrame) -> dict[str, list[tuple[float, float]]]:
    """Per language the median and scaled median deviation of every statistic."""
    med = stats.groupBy("language").agg(F.array(*[F.percentile_approx(s, 0.5, 1000) for s in STATS]).alias("m")).collect()
    centre = {r["language"]: r["m"] for r in med}
    if not centre:
        return {}
    dev = stats.groupBy("language").agg(F.array(*[F.percentile_approx(F.abs(F.col(s) - _by_language(centre, i)), 0.5, 1000) for i, s in enumerate(STATS)]).alias("d")).collect()
    return {r["language"]: [(m, max(1.4826 * d, LEAST[s])) for m, d, s in zip(centre[r["language"]], r["d"], STATS)] for r in dev}


def _by_language(values: dict[str, list[float]], i: int) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col("language") == k, F.lit(float(v[i]))).otherwise(out)
    return out


def contributions(model: dict[str, tuple[np.ndarray, np.ndarray]]) -> Column:
    """Each statistic's share of the squared distance as an array; null for a language without a model."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def split(language: pd.Series, *stats: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype="float64") for s in stats])
        out = pd.Series([None] * len(language), dtype=object)
        for k, (mean, inverse) in model.items():
            at = np.flatnonzero((language == k).to_numpy())
            z = x[at] - mean
            for i, row in zip(at, z * (z @ inverse)):
                out[i] = row
        return out

    return split("language", *STATS)


def _distance(c: str) -> Column:
    return F.expr(f"aggregate({c}, 0D, (s, x) -> s + x)")


def prose_model(stats: DataFrame, steps: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language (mean, inverse covariance) of prose, from all documents with ``PROSE`` of running text.

    A language without any such document has no model. Only sums of products per
    language come to the driver: a few hundred numbers whatever the number of
    documents.
    """
    stats = stats.where(F.col("plain_share") >= PROSE)
    start = _start(stats)
    model = {k: (np.array([m for m, _ in v]), np.diag([1 / s**2 for _, s in v])) for k, v in start.items()}
    if not model:
        return {}
    n_stats = len(STATS)
    pairs = [(i, j) for i in range(n_stats) for j in range(i, n_stats)]
    for _ in range(steps):
        seen = stats.withColumn("c", contributions(model)).withColumn("d2", _distance("c"))
        at = {r["language"]: [r["q"]] for r in seen.groupBy("language").agg(F.percentile_approx("d2", KEEP, 1000).alias("q")).collect()}
        kept = seen.where(F.col("d2") <= _by_language(at, 0))
        centre = {k: m for k, (m, _) in model.items()}
        shifted = kept.select("language", *[(F.col(s) - _by_language(centre, i)).alias(f"x{i}") for i, s in enumerate(STATS)])
        sums = shifted.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(n_stats)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}_{j}") for i, j in pairs]).collect()
        for r in sums:
            n = max(r["n"], 1)
            a = np.array([r[f"a{i}"] for i in range(n_stats)]) / n
            b = np.zeros((n_stats, n_stats))
            for i, j in pairs:
                b[i, j] = b[j, i] = r[f"b{i}_{j}"] / n
            # the kept share of a normal sample has less spread than the whole: the usual factor makes up for it
            cov = (b - np.outer(a, a)) * 1.6 + np.diag([LEAST[s] ** 2 for s in STATS])
            model[r["language"]] = (model[r["language"]][0] + a, np.linalg.inv(cov))
    return model


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics with ``distance2``, one ``c_<statistic>`` each and ``form``.

    ``form`` is null for prose. A document is listed where its distance is
    beyond ``CUT``, or its language has no prose to compare it with and less
    than half of it is running text: ``table`` where most of the rest stands in
    at least two rows of columns, ``list`` where it stands in at least two short
    entries that differ, ``junk`` otherwise. An empty document is junk.
    """
    stats = cut(document_statistics(docs, key, text))
    model = prose_model(stats)
    out = stats.withColumn("_c", contributions(model) if model else F.lit(None).cast("array<double>"))
    out = out.withColumns({f"c_{s}": F.col("_c")[i] for i, s in enumerate(STATS)}).withColumn("distance2", _distance("_c")).drop("_c")
    rest = F.greatest(1 - F.col("plain_share"), F.lit(1e-9))
    prose = F.when(F.col("distance2").isNull(), F.col("plain_share") >= PROSE).otherwise(F.col("distance2") <= CUT)
    form = (
        F.when(prose, F.lit(None).cast("string"))
        .when((F.col("rows") >= 2) & (F.col("table_share") >= 0.5 * rest), "table")
        .when((F.col("entries") >= 2) & (F.col("short_share") >= 0.5 * rest) & ((F.col("line_variety") >= 0.85) | (F.col("marked") * 2 >= F.col("lines"))), "list")
        .otherwise("junk")
    )
    return out.withColumn("form", form)


def not_prose(docs: DataFrame) -> DataFrame:
    return scored(docs).where("form is not null").select("doc_id", "form").distinct()
