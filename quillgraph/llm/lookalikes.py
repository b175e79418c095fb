"""One form for texts that look the same (problem 6).

Pieces of a text are exploded with their positions, joined with a broadcast
table of decompositions and look-alike letters, ordered by combining class
inside each base letter's segment, recomposed and put together again. A run of
code points that no rule touches travels as one piece, so only the odd
characters and their bases become rows of their own. Both tables are bounded by
Unicode itself (some ten thousand entries), not by the data.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

# Letters of other scripts whose glyphs equal a Latin letter's.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw"))
# Arabic-script letters whose joined forms equal an Arabic letter's, and hyphens without a compatibility mapping.
OTHER = {"\u06a9": "\u0643", "\u06cc": "\u064a", "\u06c1": "\u0647", "\u2010": "-", "\u2011": "-", "\u2028": "\n", "\u2029": "\n"}
#: Code points that show nothing: format characters and fillers.
_INVISIBLE_EXTRA = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"

#: Code points that no rule touches and that are never combining marks; a text of these alone is already in its one form.
SAFE = r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u060c\u061b\u061f\u0621-\u063a\u0640-\u064a\u0660-\u066d\u2013\u2014\u2018-\u201f\u2022\u25a1"


def _target(ch: str) -> str:
    """Full compatibility decomposition with look-alikes replaced; '' for invisible code points."""
    if unicodedata.category(ch) == "Cf" or ch in _INVISIBLE_EXTRA or 0xFE00 <= ord(ch) <= 0xFE0F:
        return ""
    out = unicodedata.normalize("NFKD", OTHER.get(ch, ch))
    return "".join(OTHER.get(c, GREEK.get(c, CYRILLIC.get(c, c))) for c in out)


@lru_cache(maxsize=1)
def mapping_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, [(code point, combining class)]) for every code point that a rule touches, and for all marks; Hangul syllables become their letters, which stay apart."""
    rows = []
    for n in range(0x110000):
        if 0xD800 <= n <= 0xDFFF or 0xE000 <= n <= 0xF8FF or n > 0x2FA1F and n < 0xE0000 or n > 0xE01FF:
            continue
        ch = chr(n)
        to = _target(ch)
        if to != ch or unicodedata.combining(ch):
            rows.append((ch, [(c, unicodedata.combining(c)) for c in to]))
    return rows


@lru_cache(maxsize=1)
def composition_rows() -> list[tuple[str, dict[str, str]]]:
    """(base, {sequence of marks: composed letter}) for every chain of canonical compositions."""
    out: dict[str, dict[str, str]] = {}
    for n in range(0x30000):
        if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3:
            continue
        full = unicodedata.normalize("NFD", chr(n))
        if len(full) > 1 and unicodedata.normalize("NFC", full) == chr(n) and not unicodedata.combining(full[0]) and all(map(unicodedata.combining, full[1:])):
            out.setdefault(full[0], {})[full[1:]] = chr(n)
    return sorted(out.items())


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    seq = T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("k", T.IntegerType())]))
    m = spark.createDataFrame(mapping_rows(), T.StructType([T.StructField("piece", T.StringType()), T.StructField("seq", seq)]))
    c = spark.createDataFrame(composition_rows(), T.StructType([T.StructField("base", T.StringType()), T.StructField("chain", T.MapType(T.StringType(), T.StringType()))]))
    return F.broadcast(m), F.broadcast(c)


def maybe_odd(text: Column) -> Column:
    """False where the text surely is in its one form already; null for null."""
    return text.rlike(f"[^{SAFE}]")


def _rebuilt(odd: DataFrame) -> DataFrame:
    """``rk, canon`` from ``rk, text`` (``rk`` unique)."""
    mapping, chains = _tables(odd.sparkSession)
    pieces = odd.select("rk", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s)[{SAFE}]+(?=[{SAFE}]|$)|."), F.lit(0))).alias("pos", "piece"))
    flat = (
        pieces.join(mapping, "piece", "left")
        .select("rk", "pos", F.posexplode(F.coalesce("seq", F.array(F.struct(F.col("piece").alias("c"), F.lit(0).alias("k"))))).alias("sub", "x"))
        .select("rk", "pos", "sub", "x.c", "x.k")
    )
    order = W.Window.partitionBy("rk").orderBy("pos", "sub")
    seg = flat.withColumn("seg", F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).over(order))
    bases = (
        seg.groupBy("rk", "seg")
        .agg(
            F.coalesce(F.max(F.when(F.col("k") == 0, F.col("c"))), F.lit("")).alias("base"),
            F.expr("array_sort(collect_list(struct(k, pos, sub, c)) filter (where k > 0))").alias("marks"),
        )
        .join(chains, "base", "left")
    )
    fold = """aggregate(marks, named_struct('q', '', 'rest', '', 'last', 0), (a, m) ->
        case when chain is not null and a.last < m.k and map_contains_key(chain, concat(a.q, m.c))
             then named_struct('q', concat(a.q, m.c), 'rest', a.rest, 'last', a.last)
             else named_struct('q', a.q, 'rest', concat(a.rest, m.c), 'last', m.k) end,
        a -> concat(coalesce(case when a.q = '' then base else element_at(chain, a.q) end, base), a.rest))"""
    return bases.select("rk", "seg", F.expr(f"case when size(marks) = 0 then base else {fold} end").alias("s")).groupBy("rk").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(seg, s))), x -> x.s), '')").alias("canon")
    )


def canonical_texts(df: DataFrame, text: str) -> DataFrame:
    """Distinct ``text`` values that a rule may touch, with their one form: ``text, canon``.

    Null texts are left out, an empty text has nothing to change, and very long
    texts are handled whole.
    """
    odd = df.select(F.col(text).alias("text")).where(maybe_odd(F.col("text"))).distinct()
    keyed = odd.withColumn("rk", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    done = _rebuilt(keyed)
    return keyed.join(done, "rk", "left").select("text", F.coalesce("canon", F.lit("")).alias("canon"))


def normalise(df: DataFrame, text: str, out: str = "canon") -> DataFrame:
    """``df`` with its ``text`` brought to one form in the column ``out``.

    Null stays null. Texts of plain code points pass straight through, without
    a shuffle; only the odd ones are exploded and joined back. An existing
    column named ``out`` is replaced.
    """
    src = df.drop(out) if out != text else df
    plain = src.where(~maybe_odd(F.col(text)) | F.col(text).isNull()).withColumn(out, F.col(text))
    odd = src.where(maybe_odd(F.col(text)))
    names = canonical_texts(src, text).select(F.col("text").alias("_raw"), F.col("canon").alias("_canon"))
    fixed = odd.join(names, F.col(text) == F.col("_raw"), "left").withColumn(out, F.col("_canon")).drop("_raw", "_canon")
    return plain.unionByName(fixed)


def same_looking(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``id_a < id_b`` whose texts differ but have one form.

    Rows without key, or whose text has no letter or digit, are left out;
    repeated rows count once. At least one text of such a pair is not in its
    one form, so only those rows probe the table of (key, hashes); texts
    themselves are never shuffled for the join.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    h = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    plain = rows.where(~maybe_odd(F.col("text"))).select("id", h("text").alias("raw")).withColumn("one", F.col("raw"))
    odd = (
        _rebuilt(rows.where(maybe_odd(F.col("text"))).distinct().withColumn("rk", F.struct("id", h("text").alias("raw"))))
        .select("rk.id", "rk.raw", h("canon").alias("one"))
    )
    changed = odd.where("raw != one")
    everyone = plain.unionByName(odd).distinct()
    pairs = changed.alias("x").join(everyone.alias("y"), (F.col("x.one") == F.col("y.one")) & (F.col("x.raw") != F.col("y.raw")) & (F.col("x.id") != F.col("y.id")))
    return pairs.select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b")).distinct()
