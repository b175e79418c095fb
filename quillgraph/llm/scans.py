"""Traces of scanning in paragraphs (problem 2).

Noisy-channel correction: the language model is a table of bigram counts over
all texts, the channel gives probabilities to confusions of similar glyphs.
Words below the vocabulary threshold are folded to a glyph-class key and joined
with the vocabulary on it, which finds every candidate whatever the number of
confused letters; lines that hold such words are decoded by Viterbi over the
candidates with the bigrams joined in. Running headers are title-like lines that
recur in their document or are made of the words of such lines; page numbers
are lines with nothing but the page's number; parted words are joined where the
whole is a word or the two parts are none on their own.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.runtime import cut

#: A word is vocabulary from this share of all words on (and five times at least); its misreadings are at least RATIO times rarer.
SHARE, LEAST, RATIO = 4e-5, 5, 20
#: Greatest probability of one confusion, and that of one never seen alone; weight of bigrams against single words.
CONFUSION, UNSEEN, BIGRAM = 0.01, 1e-7, 0.9
#: Rows of a lookup table up to which it is broadcast (some 10 MB); beyond, the join shuffles.
SMALL = 100_000

# Letters taken for each other; what some letters are read as when they fall apart or change places.
WIDE = {"w": "vv", "u": "ii", "m": "rn", "d": "cl", "h": "li", "\u0644\u0627": "\u0627\u0644"}
CLASSES = ["ec", "il1", "tf", "o0", "s5", "g9", "b6", "تث", "جحخ", "قف", "زر", "شس", "ضص", "طظ", "عغ", "دذ"]
_HYPHENS = "\\-\u00ad\u00ac\u2010\u0640"
#: Where a word is parted at a line's end; starts with the rare character, so that texts are scanned fast.
GAP = rf"[{_HYPHENS}](?<=[\p{{L}}\p{{M}}][{_HYPHENS}])[ \t]*\r?\n[ \t]*(?=[\p{{L}}\p{{M}}])"
#: The same with the two parts and the mark captured.
PARTED = rf"([\p{{L}}\p{{M}}]+)([{_HYPHENS}])[ \t]*\r?\n[ \t]*([\p{{L}}\p{{M}}]+)"
_NUMBER = "[0-9\u0660-\u0669]"
#: A line with nothing but a page number, with or without the number of pages; the number captured.
_PAGE_WORD = "(?:[Pp][Aa][Gg9][EeCc]|[Pp]\\.|\u0635\u0641\u062d\u0629|\u0635\\.)"
PAGE_LINE = rf"(?m)^[ \t]*(?:{_PAGE_WORD}[ \t]*)?[\[\(|\-\u2013\u2014]*[ \t]*({_NUMBER}{{1,6}})[ \t]*(?:(?:of|\u0645\u0646|/)[ \t]*{_NUMBER}{{1,6}}[ \t]*)?[\]\)|\-\u2013\u2014]*[ \t]*\r?$"
#: A page number before or after a title in the same line.
_BEFORE = rf"^\s*[\[\(|\-\u2013\u2014]*\s*(?:{_PAGE_WORD}\s*)?{_NUMBER}{{1,6}}(?:\s*[\]\)|\-\u2013\u2014:]+\s*|\s{{2,}})(?=\S)"
_AFTER = rf"(?<=\S)(?:\s{{2,}}|\s*[\[\(|\-\u2013\u2014]+\s*)(?:{_PAGE_WORD}\s*)?{_NUMBER}{{1,6}}\s*[\]\)|\-\u2013\u2014]*\s*$"


def fold(c: Column) -> Column:
    """Glyph-class key: equal for words that differ in confusable letters only."""
    for one, two in WIDE.items():
        c = F.replace(c, F.lit(one), F.lit(two))
    src = "".join(k[1:] for k in CLASSES)
    dst = "".join(k[0] * (len(k) - 1) for k in CLASSES)
    return F.translate(c, src, dst)


def _fold(w: str) -> str:
    for one, two in WIDE.items():
        w = w.replace(one, two)
    return w.translate({ord(x): k[0] for k in CLASSES for x in k[1:]})


def confused(word: str, seen: str) -> list[str] | None:
    """Fewest confusions that turn ``word`` into ``seen``, each as ``read:as``; None where none do."""
    same = {x: k[0] for k in CLASSES for x in k}
    steps = [(a, b) for a, b in WIDE.items()] + [(b, a) for a, b in WIDE.items()]
    best: dict[tuple[int, int], tuple[int, tuple[str, ...]]] = {(0, 0): (0, ())}
    for i in range(len(word) + 1):
        for j in range(len(seen) + 1):
            if (i, j) not in best:
                continue
            n, path = best[i, j]
            moves = [(a, b) for a, b in steps if word.startswith(a, i) and seen.startswith(b, j)]
            if i < len(word) and j < len(seen) and same.get(word[i], word[i]) == same.get(seen[j], seen[j]):
                moves.append((word[i], seen[j]))
            for a, b in moves:
                to = (n, path) if a == b else (n + 1, (*path, f"{a}:{b}"))
                k = (i + len(a), j + len(b))
                best[k] = min(best.get(k, to), to)
    got = best.get((len(word), len(seen)))
    return None if got is None else list(got[1])


#: Characters between words, as the complement of few ranges (cheaper to test than Unicode classes).
_BETWEEN = "[^a-z\u0620-\u063f\u0641-\u0669A-Z0-9\u00c0-\u05ff\u066e-\u06d3\u06d5-\u1fff\u3040-\uffff\\x{10000}-\\x{10ffff}]+"


def joined(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, GAP, "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in their case; the first and last may be empty."""
    return F.split(joined(text), _BETWEEN)


def raw_bigrams(texts: DataFrame, text: str) -> DataFrame:
    """``a, b, n``: how often token ``b`` follows ``a`` in the texts' own case; null ``b`` at the end of a text."""
    t = texts.select(tokens(F.col(text)).alias("t")).select(F.explode_outer(F.expr("arrays_zip(t, slice(t, 2, size(t)))")).alias("p")).select(F.col("p.t").alias("a"), F.col("p.1").alias("b"))
    return t.where("a != ''").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _shape(c: str) -> Column:
    """Lower-cased; numbers become ``#``."""
    return F.when(F.col(c).rlike(rf"^{_NUMBER}+$"), "#").otherwise(F.lower(c))


def bigram_counts(raw: DataFrame) -> DataFrame:
    """``a, b, n, low``: bigrams without case ('' for none), ``low`` of them with ``a`` in lower case."""
    return raw.select(_shape("a").alias("a"), F.coalesce(_shape("b"), F.lit("")).alias("b"), "n", (F.col("a") == F.lower("a")).alias("l")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("l"), F.col("n")).otherwise(0)).alias("low"))


def word_counts(bigrams: DataFrame) -> DataFrame:
    return bigrams.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"), F.sum("low").alias("low"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast behind a count of the (already materialised) rows; the join shuffles beyond ``SMALL``."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def lexicon(words: DataFrame, total: int) -> DataFrame:
    """``seen, word, ns, nv, how``: rare words, the vocabulary words they may be misread from, and the confusions between them.

    Vocabulary is judged by lower-case use, so proper names are none.
    """
    least = max(LEAST, SHARE * total)
    folded = words.where(F.col("word").rlike(r"\p{L}")).withColumn("f", fold(F.col("word")))
    vocab = folded.where(F.col("low") >= least).select("f", "word", F.col("n").alias("nv"))
    rare = folded.where((F.col("low") < least) & (F.length("word") >= 2)).select("f", F.col("word").alias("seen"), F.col("n").alias("ns"))
    pairs = rare.join(vocab, "f").where((F.col("nv") >= RATIO * F.col("ns")) & ((F.length("seen") >= 3) | F.col("seen").rlike("[0-9]")))
    how = F.pandas_udf(lambda a, b: pd.Series([confused(x, y) for x, y in zip(a, b)]), "array<string>")
    return pairs.withColumn("how", how("word", "seen")).where("how is not null").select("seen", "word", "ns", "nv", "how")


def glyphs() -> list[str]:
    """Every glyph of the confusion tables, on either side; some seventy."""
    return sorted({*"".join(CLASSES), *WIDE, *WIDE.values()})


def channel(lex: DataFrame, words: DataFrame, total: int) -> dict[str, float]:
    """Probability of each confusion, from all texts: misread forms of it over the places where it could happen.

    Forms one confusion away count; half a case is added to each kind, and no
    kind is likelier than ``CONFUSION``. As many numbers as there are kinds
    of confusions come to the driver, whatever the data.
    """
    seen = {r["c"]: r["n"] for r in lex.where("size(how) = 1").groupBy(F.col("how")[0].alias("c")).agg(F.sum("ns").alias("n")).collect()}
    vocab = words.where(F.col("low") >= max(LEAST, SHARE * total))
    g = glyphs()
    row = vocab.agg(*[F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(x), F.lit("")))) / len(x)).alias(f"g{i}") for i, x in enumerate(g)]).first()
    places = {x: float(row[f"g{i}"] or 0) for i, x in enumerate(g)}
    return {c: min(CONFUSION, (n + 0.5) / (places.get(c.split(":")[0], 0.0) + 1)) for c, n in seen.items()}


def odd_lines(paragraphs: DataFrame, page: str = "page") -> DataFrame:
    """Lines of paragraphs that could be page furniture, a paragraph's only line too: ``docName, elementId, page, line, no, key``.

    ``no`` is the number of a line with nothing but a page number. Any other
    line may be a title, wherever it stands, as pages end inside paragraphs: it
    has no punctuation at its end and, in Latin script, capitals; without a
    number at its end it is short. ``key`` is the title without its page number
    at either end, lower-cased and folded.
    """
    ends = paragraphs.where(F.col("text").contains("\n") | (F.length("text") <= 90)).select("docName", "elementId", page, F.explode_outer(F.split("text", "\r?\n")).alias("line"))
    # cheap tests first: most lines are too long, or hold no number at either end
    number = rf"{_NUMBER}"
    ends = ends.where((F.length("line") <= 38) | ((F.length("line") <= 90) & (F.left("line", F.lit(9)).rlike(number) | F.right("line", F.lit(9)).rlike(number))))
    no = F.when((F.length("line") <= 38) & F.col("line").rlike(number), F.nullif(F.regexp_extract("line", PAGE_LINE, 1), F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", _BEFORE, ""), _AFTER, ""))
    title = F.col("bare").rlike(r"^(?:[\p{Lu}0-9][\p{L}\p{M}0-9'&./-]*|of|and|the|for|in|on|to)(?:\s+(?:[\p{Lu}0-9][\p{L}\p{M}0-9'&./-]*|of|and|the|for|in|on|to))*$") | (F.col("bare").rlike(r"^[\u0621-\u064a]") & (F.size(F.split("bare", r"\s+")) <= 7))
    short = F.col("bare").rlike(rf"{_NUMBER}$") | ((F.length("bare") <= 38) & (F.size(F.split("bare", r"\s+")) <= 5))
    open_end = F.col("line").rlike(r"\p{L}") & ~F.col("line").rlike(rf"[.!?:;,،؛؟{_HYPHENS}]\s*$")
    lines = ends.withColumn("no", no).where(F.col("no").isNotNull() | open_end).withColumn("bare", F.when(F.col("no").isNull(), bare))
    key = F.when(title & short, fold(F.lower(F.regexp_replace("bare", r"\s+", " "))))
    return lines.select("docName", "elementId", page, "line", "no", key.alias("key")).where("no is not null or key is not null")


#: How a number at the end of a folded key looks: folding takes some digits for letters.
_KEY_NUMBER = r"\s[0-9oigsb\u0660-\u0669]+"


def header_lines(odd: DataFrame) -> DataFrame:
    """Distinct ``elementId, line`` that are the running header of their document.

    A key that stands in two elements of a document is its title. Where a
    document shows its title once, the line counts if it ends with a number and
    all its words are words of such titles.
    """
    b = odd.where("key is not null").select("docName", "elementId", "line", "key").distinct()
    often = b.groupBy("docName", "key").agg(F.count_distinct("elementId").alias("n")).where("n >= 2")
    top = often.groupBy("docName").agg(F.max("n").alias("top"))
    # wrapped lines recur by chance in long documents, but never as often as the title; without a number they need a third place
    title = often.join(top, "docName").where((F.col("n") >= 0.3 * F.col("top")) & (F.col("key").rlike(rf"{_KEY_NUMBER}$") | (F.col("n") >= 3))).select("docName", "key")
    sure = b.join(title, ["docName", "key"], "left_semi")
    strip = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    known = title.select(F.explode_outer(strip(F.col("key"))).alias("w")).where("w is not null").distinct().withColumn("k", F.lit(1))
    rest = b.join(title, ["docName", "key"], "left_anti").where(F.col("key").rlike(rf"{_KEY_NUMBER}$"))
    w = rest.select("elementId", "line", F.explode_outer(strip(F.col("key"))).alias("w")).where("w is not null").join(known, "w", "left")
    also = w.groupBy("elementId", "line").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("k")).where("n = k and n between 2 and 8").select("elementId", "line")
    return sure.select("elementId", "line").unionByName(also).distinct()


def western(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩", "0123456789").cast("int")


def page_numbers(odd: DataFrame, page: str = "page") -> DataFrame:
    """Distinct ``elementId, line`` with nothing but the page's number; any number will do where the page is null.

    ``page`` may also hold an array of pages.
    """
    no, p = western(F.col("no")), F.col(page)
    own = F.array_contains(p, no) if odd.schema[page].dataType.typeName() == "array" else no == p
    return odd.where("no is not null").where(p.isNull() | own).select("elementId", "line").distinct()


def parted_words(paragraphs: DataFrame, words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Distinct ``elementId, left, mark, right`` of words parted between lines.

    A soft or special hyphen always parts a word. A plain one may also be the
    word's own: it does not where the whole is no word of the texts while the
    two parts follow each other as words elsewhere.
    """
    hit = paragraphs.where(F.col("text").contains("\n") & F.col("text").rlike(GAP)).withColumn("m", F.regexp_extract_all("text", F.lit(PARTED), F.lit(0)))
    p = hit.select("elementId", F.explode_outer("m").alias("m")).select("elementId", *[F.regexp_extract("m", PARTED, i + 1).alias(c) for i, c in enumerate(("left", "mark", "right"))]).distinct()
    p = cut(p)  # read by both branches below
    plain = p.where((F.col("mark") == "-") & F.col("left").rlike("[A-Za-z]")).withColumn("w", F.lower(F.concat("left", "right")))
    whole = plain.join(words.select(F.col("word").alias("w"), F.col("n").alias("nw")), "w", "left").withColumns({"a": F.lower("left"), "b": F.lower("right")})
    apart = whole.join(bigrams.select("a", "b", F.col("n").alias("nb")), ["a", "b"], "left")
    # the pair's own joined form is among the words once for each time it was parted
    own = apart.where(~((F.coalesce("nb", F.lit(0)) >= 3) & (F.coalesce("nb", F.lit(0)) > F.coalesce("nw", F.lit(0)) / 4))).select("elementId", "left", "mark", "right")
    return p.where(~((F.col("mark") == "-") & F.col("left").rlike("[A-Za-z]"))).unionByName(own)


_PARTED = re.compile(rf"([^\W\d_]+)([{_HYPHENS}])[ \t]*\r?\n[ \t]*([^\W\d_]+)")


def viterbi(seen: list[str], options: dict[str, list[tuple[str, float, float]]], pair: dict[tuple[str, str], int], single: dict[str, int], total: int) -> list[str]:
    """The likeliest words behind ``seen``: bigram model times confusion channel.

    ``options`` gives a form's candidate words, each with the logarithm of the
    channel's probability and the form's count over the word's. A form with
    options is a candidate too, read rightly. What speaks for it is the word
    before: it followed that one more often than its candidates do, times that
    share, explain (by more than chance, three times the root). Its own occurrence
    here never counts.
    """

    def lm(a: str, b: str) -> float:
        both, one = pair.get((a, b), 0), single.get(b, 0)
        if b in options:
            explained = sum(pair.get((a, w), 0) * x for w, _, x in options[b])
            both, one = max(0.0, both - 1 - explained - 3 * math.sqrt(explained)), 0
        own = 1 if a in options else 0
        two = max(0, both - own) / max(1, single.get(a, 0) - own)
        return math.log(BIGRAM * two + (1 - BIGRAM) * (one + 0.5) / (total + 1))

    layers: list[dict[str, tuple[float, str | None]]] = [{"": (0.0, None)}]
    for w in seen:
        layer = {}
        for cand, log_p, _ in [(w, 0.0, 0.0), *options.get(w, [])]:
            layer[cand] = max((v + lm(a, cand) + log_p, a) for a, (v, _) in layers[-1].items())
        layers.append(layer)
    word = max(layers[-1], key=lambda x: layers[-1][x][0])
    out = []
    for layer in reversed(layers[1:]):
        out.append(word)
        word = layer[word][1]
    return out[::-1]


_GAP = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_RUN = re.compile("[" + _BETWEEN[2:-2].replace("\\x{10000}-\\x{10ffff}", "\U00010000-\U0010ffff") + "]+")


def _suspect_rows(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows whose text holds a token of ``seen`` (in its own case).

    Up to ``SMALL`` tokens go to the workers as a set and texts are tested in
    Arrow batches, which takes a quarter of the time of exploding all words;
    with more of them words are exploded and joined.
    """
    rows = seen.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        flat = texts.select("elementId", "rk", F.explode_outer(tokens(F.col("text"))).alias("a"))
        return texts.join(flat.join(seen, "a", "left_semi").select("elementId", "rk").distinct(), ["elementId", "rk"], "left_semi")
    words = texts.sparkSession.sparkContext.broadcast(frozenset(r["a"] for r in rows))

    def run(batches):
        known = words.value
        for b in batches:
            yield b[[not known.isdisjoint(_RUN.findall(_GAP.sub("", t) if "\n" in t else t)) for t in b["text"]]]

    return texts.mapInPandas(run, texts.schema)


def _clean(text: str, drop, cuts) -> str:
    """``text`` without the lines of ``drop``; words parted between lines are joined, those of ``cuts`` without their hyphen."""
    gone = set(drop) if drop is not None else set()
    body = "\n".join(x for x in re.split(r"\r?\n", text) if x not in gone)
    marks = set(cuts) if cuts is not None else set()
    return _PARTED.sub(lambda g: g.group(1) + g.group(3) if g.group(1) + g.group(2) + g.group(3) in marks else g.group(1) + g.group(2) + g.group(3), body)


@F.pandas_udf(T.StringType())
def _cleaned(text: pd.Series, drop: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([_clean(*x) for x in zip(text, drop, cuts)])


def corrections(texts: DataFrame, furniture: DataFrame, cuts: DataFrame, model: Model) -> DataFrame:
    """``elementId, rk, i, seen, word``: the misread words of ``texts`` (``elementId, rk, text``) and what Viterbi reads them as.

    ``i`` is the place among the words of the text without page furniture and
    with parted words joined, so one form may be read differently at two places.
    """
    rows = cut(_suspect_rows(texts.select("elementId", "rk", "text"), model.seen).distinct())
    fed = rows.join(furniture, "elementId", "left").join(cuts, "elementId", "left")
    body = fed.select("elementId", "rk", _cleaned("text", "drop", "cuts").alias("body"))
    shaped = F.transform(F.filter(F.split("body", _BETWEEN), lambda x: x != ""), lambda x: F.when(x.rlike(rf"^{_NUMBER}+$"), "#").otherwise(F.lower(x)))
    lines = cut(body.select("elementId", "rk", F.struct("elementId", "rk").alias("row"), shaped.alias("t")))
    at = lines.select("row", F.posexplode_outer("t").alias("i", "seen")).where("seen is not null")
    spots = at.join(_small(model.lexicon), "seen")
    # the spots with their options and neighbours form the lattice; every edge asks the bigram table once
    near = spots.select("row", F.explode(F.expr("sequence(i - 1, i + 1)")).alias("i")).distinct().join(at, ["row", "i"])
    states = near.select("row", "i", F.col("seen").alias("w")).unionByName(spots.select("row", "i", F.col("word").alias("w"))).distinct()
    nxt = states.select("row", (F.col("i") - 1).alias("i"), F.col("w").alias("b"))
    edges = states.withColumnRenamed("w", "a").join(nxt, ["row", "i"]).select("row", "a", "b").distinct().join(model.bigrams.select("a", "b", F.col("n").alias("ab")), ["a", "b"]).groupBy("row").agg(F.collect_set(F.struct("a", "b", "ab")).alias("pairs"))
    singles = states.select("row", "w").distinct().join(model.words.select(F.col("word").alias("w"), "n"), "w").groupBy("row").agg(F.collect_set(F.struct("w", "n")).alias("singles"))
    opts = spots.groupBy("row").agg(F.collect_set(F.struct("seen", "word", "ns", "nv", "how")).alias("options"))
    fed = lines.select("row", "t").join(opts, "row").join(singles, "row", "left").join(edges, "row", "left")
    rates, total = model.channel, model.total

    def run(batches):
        for b in batches:
            out = []
            for row, t, o, s, p in zip(b["row"], b["t"], b["options"], b["singles"], b["pairs"]):
                options: dict[str, list[tuple[str, float, float]]] = {}
                for x in o:
                    log_p = sum(math.log(rates.get(c, UNSEEN)) for c in x["how"])
                    options.setdefault(x["seen"], []).append((x["word"], log_p, x["ns"] / x["nv"]))
                single = {x["w"]: x["n"] for x in s} if s is not None else {}
                pair = {(x["a"], x["b"]): x["ab"] for x in p} if p is not None else {}
                got = viterbi(list(t), options, pair, single, total)
                out += [(row["elementId"], row["rk"], i, x, y) for i, (x, y) in enumerate(zip(t, got)) if x != y]
            yield pd.DataFrame(out, columns=["elementId", "rk", "i", "seen", "word"])

    return fed.select("row", "t", "options", "singles", "pairs").mapInPandas(run, "elementId string, rk long, i int, seen string, word string")


class Model:
    """Statistics over all elements: bigrams, words, the lexicon of misreadings, the channel and the headers.

    Words that only ``others`` (``text``) hold count as rare ones, so that their
    misreadings are known too; copies of the elements' texts are not counted twice.
    """

    def __init__(self, elements: DataFrame, others: DataFrame | None = None) -> None:
        e = elements.select("docName", "page", "elementType", "elementId", "text").where("text is not null")
        self.paragraphs = e.where("elementType = 'paragraph' and elementId is not null")
        raw = cut(raw_bigrams(e, "text"))
        self.bigrams = cut(bigram_counts(raw))
        self.words = cut(word_counts(self.bigrams))
        self.total = int(self.words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        forms = raw.select("a").distinct()
        if others is not None:
            more = cut(others.select(F.explode(tokens(F.col("text"))).alias("a")).where("a != ''").distinct().join(forms, "a", "left_anti"))
            new = more.select(_shape("a").alias("word")).distinct().join(self.words, "word", "left_anti")
            self.words = cut(self.words.unionByName(new.select("word", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("low"))))
            forms = forms.unionByName(more)
        self.lexicon = cut(lexicon(self.words, self.total))
        self.channel = channel(self.lexicon, self.words, self.total)
        self.seen = cut(forms.join(self.lexicon.select(F.col("seen").alias("low")).distinct(), F.lower("a") == F.col("low"), "left_semi"))
        self.odd = cut(odd_lines(self.paragraphs))
        self.headers = cut(header_lines(self.odd))
        self.parted = cut(parted_words(self.paragraphs, self.words, self.bigrams))
        self.pages = cut(page_numbers(self.odd))


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.select("elementId", F.xxhash64("text").alias("rk"), "text")


def _lists(furniture: DataFrame, parted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per element: the lines to ``drop`` and the joints to ``cuts``."""
    return furniture.groupBy("elementId").agg(F.collect_set("line").alias("drop")), parted.groupBy("elementId").agg(F.collect_set(F.concat("left", "mark", "right")).alias("cuts"))


def noise(elements: DataFrame) -> DataFrame:
    """Distinct ``elementId, noise`` of paragraphs with traces of scanning.

    Null texts and other element types have none; repeated rows count once;
    columns beyond docName, page, elementType, elementId and text are ignored.
    """
    m = Model(elements)
    drop, cuts = _lists(m.headers.unionByName(m.pages), m.parted)
    kinds = [
        ("line_break", m.parted),
        ("misread", corrections(_keyed(m.paragraphs), drop, cuts, m)),
        ("running_header", m.headers),
        ("page_number", m.pages),
    ]
    out = None
    for name, ids in kinds:
        part = ids.select("elementId", F.lit(name).alias("noise"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _restored(texts: DataFrame, furniture: DataFrame, parted: DataFrame, model: Model, lines: str) -> DataFrame:
    """``elementId, text`` of ``texts`` repaired; ``lines`` is the pattern of line ends inside a paragraph.

    Only texts with something to repair besides line ends go through Python.
    """
    texts = _keyed(texts)
    drop, cuts = _lists(furniture, parted)
    fixes = corrections(texts, drop, cuts, model).groupBy("elementId", "rk").agg(F.collect_set(F.struct("i", "word")).alias("fixes")).groupBy("elementId").agg(F.collect_list(F.struct("rk", "fixes")).alias("fixes"))
    known = drop.join(cuts, "elementId", "full").join(fixes, "elementId", "full").withColumn("hit", F.lit(True))

    @F.pandas_udf("string")
    def restore(text: pd.Series, rk: pd.Series, drop: pd.Series, cuts: pd.Series, fixes: pd.Series) -> pd.Series:
        out = []
        for t, k, d, c, f in zip(text, rk, drop, cuts, fixes):
            if t is None:
                out.append(None)
                continue
            body = _clean(t, d, c)
            at = {x["i"]: x["word"] for y in f if y["rk"] == k for x in y["fixes"]} if f is not None else {}
            if at:
                n = iter(range(len(body) + 1))
                body = _RUN.sub(lambda g: _cased(g.group(0), at.get(next(n))), body)
            out.append(body)
        return pd.Series(out, dtype=object)

    # one shuffle of the texts serves both the repeated rows and the join
    rows = texts.repartition("elementId").dropDuplicates(["elementId", "rk"]).join(known, "elementId", "left")
    # untouched texts stay in the JVM: Python is handed nulls for them
    body = F.coalesce(restore(F.when(F.col("hit"), F.col("text")), "rk", "drop", "cuts", "fixes"), "text")
    flat = F.when(body.contains("\n"), F.regexp_replace(body, lines, " ")).otherwise(body)
    return rows.select("elementId", F.trim(flat).alias("text"))


def repaired(elements: DataFrame) -> DataFrame:
    """``elementId, text`` of every paragraph as continuous text.

    Headers and page numbers are taken out, parted words joined, misread words
    replaced place by place and the remaining lines joined by blanks. Equal rows
    count once; an element stored with different texts has a row for each.
    """
    m = Model(elements)
    return _restored(m.paragraphs, m.headers.unionByName(m.pages), m.parted, m, r"\s*\n\s*")


def repaired_chunks(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunkId, text`` of every chunk, repaired by the model of the elements.

    A chunk's running headers are the lines that are headers of its document's
    elements; its page numbers stand on a page that it covers. Paragraphs,
    parted by empty lines, become continuous; lines of lists and tables stay.
    Null ids and texts drop out.
    """
    m = Model(elements, chunks)
    c = chunks.select(F.col("chunkId").alias("elementId"), "docName", "pages", "text").where("elementId is not null and text is not null")
    heads = m.headers.join(m.paragraphs.select("elementId", "docName").distinct(), "elementId").select("docName", "line").distinct()
    odd = cut(odd_lines(c, "pages"))
    furniture = odd.join(heads, ["docName", "line"], "left_semi").select("elementId", "line").unionByName(page_numbers(odd, "pages")).distinct()
    parted = parted_words(c, m.words, m.bigrams)
    item = r"(?:[-*+•–□▪◦|]|\(?[0-9٠-٩]{1,3}[.)])"
    return _restored(c, cut(furniture), cut(parted), m, rf"(?<![\n|])[ \t]*\r?\n[ \t]*(?![\r\n]|{item})").withColumnRenamed("elementId", "chunkId")


def _cased(seen: str, word: str | None) -> str:
    if word is None:
        return seen
    return word.upper() if seen.isupper() and len(seen) > 1 else word.capitalize() if seen[:1].isupper() else word
