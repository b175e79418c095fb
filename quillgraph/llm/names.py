"""Variant spellings of the names of persons and organisations (problem 1).

A spelling is parsed into words; its head is the rarest of them that more than
one spelling shares, up to typing errors (a family's or a brand's word). The
vector of a spelling is the tensor product of its words' character n-gram
vectors: grams of the head weighted by their rarity, times those of each word
around it in order. The cosine of two spellings is then the product of their
words' cosines, so one word that differs (a given name, a field) parts members of
a family and sister companies that share all the rest. A distributed sparse
join finds the pairs: heads meet on long grams, of which only those that a pair
above the threshold must share take part (prefix filtering), or on the word
without one letter; spellings meet on their heads and the letters of the next
word, or its acronym. Pairs above a threshold are grouped by average linkage:
in each round every cluster finds its top neighbour and the reciprocal pairs
merge, which gives the same tree as one merge after the other and never brings
a family into one task. Lists of given names, titles and fields only bring
words to full forms.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.runtime import cut, cut_in_loop

#: Least cosine of a pair of head words, of a pair of spellings, and least average cosine of two clusters that merge.
COSINE, PAIR, LINK = 0.3, 0.15, 0.22
#: What a word that one of two spellings leaves out, and what an acronym for words, leave of their cosine.
LEFT_OUT, ACRONYM = 0.9, 0.9

# Titles, legal forms, kinds of organisations, given names with their short and other forms.
TITLES = set("dr mr mrs ms miss prof eng sir madam professor doctor engineer الدكتور دكتور الدكتورة د م أ ا السيد السيدة المستشار المستشارة المهندس المهندسة الاستاذ الأستاذ الاستاذة استاذ الشيخ الحاج".split())
LEGAL = set("limited ltd holding hold hldg sae plc inc llc company_ co_ ش م".split())
ORG_WORDS = set("bank bk corporation corp company co fund fd leasing lsg insurance ins holding hold hldg limited ltd sae authority commission agency association".split())
ORG_AR = set("بنك البنك شركة الشركة مؤسسة المؤسسة صندوق الصندوق هيئة الهيئة مصرف المصرف".split())
FORMS = {
    "ahmed": "ahmad ahmet", "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "catherine": "katherine kathryn cathy kate katie kathy cath", "charles": "charlie chuck chas",
    "daniel": "dan danny", "edward": "ed eddie ted ned", "elizabeth": "liz beth lizzie betty eliza lisa elisabeth", "fatima": "tima fatma fatimah fatema", "gabriella": "gaby gabby ella gabriela", "hussein": "hussain husein hossein husayn hosein",
    "ibrahim": "ebrahim ibraheem brahim", "james": "jim jimmy jas", "joseph": "joe joey jos youssef yusuf yousef", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge", "michael": "mike mick micky",
    "mohamed": "muhammad mohammed mohammad mohd muhammed mohamad", "nicholas": "nick nicky nicolas nico", "omar": "umar omer", "patricia": "pat patty tricia trish", "richard": "rick dick rich", "robert": "bob bobby rob robbie robt",
    "samuel": "sam sammy saml", "theodore": "theo ted teddy", "thomas": "tom tommy thos", "victoria": "vicky vic tori vicki", "william": "bill will billy willy wm liam", "yasmine": "yasmin jasmine yasmeen jasmin", "zachary": "zach zack zac zak",
    "جمال": "جيمي جيمى", "احمد": "حماده", "محمد": "حماده ميدو", "نورا": "نوره نور", "فاطمه": "فطوم بطه", "ابراهيم": "هيما", "ليلي": "لولا لوله", "يحيي": "يحيا", "خديجه": "خدوجه", "كريم": "كيمو", "طارق": "طروق", "مني": "منمن", "ساره": "سوسو", "اسامه": "اوسا",
    "رضا": "رضى", "هبهالله": "هبه", "عبدالرحمن": "عبده رحمن", "عبدالعزيز": "عزوز عبده", "عبدالله": "عبده",
}
#: Words of an organisation's kind or field, of which its brand is none.
FIELDS = set(
    "bank corporation company fund leasing insurance finance investment export import industrial commercial cooperative agricultural housing maritime national international development reconstruction "
    "central general federal reserve trust capital securities exchange union group services authority regulatory commission agency association trading savings credit mortgage "
    "بنك شركه مؤسسه مءسسه موسسه صندوق هييه هيءه مصرف تجاري زراعي عقاري صناعي بحري وطني استثماري دولي تعاوني مركزي عربي اهلي اسلامي عام ماليه".split()
)
NICKS: dict[str, set[str]] = {}
for _full, _shorts in FORMS.items():
    for _s in [_full, *_shorts.split()]:
        NICKS.setdefault(_s, set()).add(_full)
#: Labels that mark a person or an organisation in a span.
NAME_LABELS = ("Person", "BankingInstitution", "RegulatoryBody", "Organization", "Organisation", "FinancialInstitution")
_AR = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ـ": None, "«": " ", "»": " ", "“": " ", "”": " ", "\"": " ", "’": "'"})
_TITLES = {t.translate(_AR) for t in TITLES}
_ORG_AR = {t.translate(_AR) for t in ORG_AR}


def parse(text: str) -> tuple[str, list[str]]:
    """``(kind, words)`` of a spelling; words in order, a comma's parts turned round.

    kind is ``org`` or ``person``. Titles, articles and legal forms are left
    out; a dotted or capital acronym becomes a word that starts with ``=``.
    """
    t = re.sub("[ً-ٰٟ​-‏﻿]", "", text).translate(_AR).strip()
    if re.search("[ء-ي]", t):
        parts = [p.strip() for p in re.split("[،,]", t) if p.strip()]
        t = " ".join([*parts[1:], parts[0]]) if parts else ""
        t = re.sub(r"(?<!\S)(عبد)\s+(?=\S)", r"\1", t)
        t = re.sub(r"(?<!\S)(هبه)\s+(الله)", r"\1\2", t)
        w = [x for x in re.split(r"[\s./()\-]+", t) if x]
        while len(w) > 1 and w[0] in _TITLES:
            w = w[1:]
        w = [x for i, x in enumerate(w) if x not in _TITLES or len(x) > 2 and i == 0] or w
        if any(x in _ORG_AR for x in w):
            return "org", [x[2:] if x.startswith("ال") and len(x) > 4 else x for x in w]
        return "person", w
    parts = [p.strip() for p in t.split(",") if p.strip()]
    t = " ".join([*parts[1:], parts[0]]) if parts else ""
    t = re.sub(r"\b(?:S\s*\.?\s*A\s*\.?\s*E)\b\.?", " SAE ", t, flags=re.I)
    t = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda g: " =" + g.group(1).replace(".", "") + " ", t)
    t = re.sub(r"\b([Cc][Oo])-(?=[A-Za-z])|(?<=[A-Za-z])'(?=[A-Za-z])", r"\1", t)
    raw = [x for x in re.split(r"[\s.()/\-]+", t) if x and x not in "&'"]
    low = [x.lower() for x in raw]
    upper = t.upper() == t
    org = low[:1] == ["the"] or "of" in low or any(x in ORG_WORDS for x in low) or any(x.startswith("=") for x in low) or (not upper and _has_acronym(raw, low))
    if not org:
        w = [x for x in low if x not in TITLES]
        return "person", w or low
    out = []
    for x, y in zip(raw, low):
        if y in ("the", "of", "and", "for") or y in LEGAL:
            continue
        short = 2 <= len(x) <= 5 and x.isupper() and y not in ORG_WORDS and (not upper or len(x) <= 4 and not re.search("[AEIOU].*[AEIOU]", x))
        out.append("=" + y if short and not x.startswith("=") and y not in _SHORT else y)
    return "org", out or low


_SHORT = set("bk co ins inv ind dev exp fin fd nat mar int agri comm corp lsg hsg coop recon".split())


def _has_acronym(raw: list[str], low: list[str]) -> bool:
    """Does an undotted acronym follow a brand? Words beside a title, an initial or a known given name belong to a person."""
    if any(y in TITLES or len(y) == 1 or _full(y) for y in low):
        return False
    return any(2 <= len(x) <= 5 and x.isupper() and y not in _GENERATION for x, y in zip(raw[1:], low[1:]))


_GENERATION = set("jr sr ii iii iv".split())


def edits(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance, ``most + 1`` beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur.append(v)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


@lru_cache(maxsize=100_000)
def _full(a: str) -> frozenset[str]:
    got = NICKS.get(a)
    if got:
        return frozenset(got)
    # a typing error in a known name
    return frozenset(f for k, fs in NICKS.items() if len(k) >= 5 and edits(a, k, 1) <= 1 for f in fs) if len(a) >= 4 else frozenset()


def _abbreviates(a: str, w: str) -> bool:
    if len(a) >= len(w) or len(a) > 5 or a[0] != w[0]:
        return False
    if w.startswith(a):
        return len(a) >= 2
    it = iter(w)
    return all(c in it for c in a) and not re.search("[aeiou]", a[1:])


def _full_field(w: str) -> str:
    """The field or kind that a word stands for, itself where none or several do."""
    if w in FIELDS or w[0] == "=":
        return w
    got = {f for f in FIELDS if _abbreviates(w, f)} or ({f for f in FIELDS if edits(w, f, 1) <= 1} if len(w) >= 5 else set())
    first = {f for f in got if f.startswith(w)}
    return next(iter(got)) if len(got) == 1 else next(iter(first)) if len(first) == 1 else w


def is_field(w: str) -> bool:
    return w[0] == "=" or _full_field(w) in FIELDS or any(_abbreviates(w, f) for f in FIELDS)


def heads(kind: str, words: list[str]) -> list[str]:
    """The words that may be the family's or the brand's: those that are no given name, field or kind."""
    got = [w for w in words if len(w) >= 3 and not (is_field(w) if kind == "org" else _full(w))]
    return got or [w for w in words if w[0] != "="][-1:] or words[-1:]


def around(kind: str, words: list[str], head: str) -> list[str]:
    """The words around the head in full forms: given names of nicknames and typing errors, fields of abbreviations."""
    i = words.index(head)
    rest = words[:i] + words[i + 1 :]
    if kind == "org":
        return [_full_field(w) for w in rest]
    return [next(iter(f)) if len(f := _full(w)) == 1 else w for w in rest]


@lru_cache(maxsize=200_000)
def word_vector(w: str) -> dict[str, float]:
    """Unit vector of a word around the head: its first letter, and its 2- and 3-grams; that of a short form of several names lies between theirs."""
    full = NICKS.get(w, ())
    if len(full) > 1:
        out: dict[str, float] = {}
        for f in sorted(full):
            for g, v in word_vector(f).items():
                out[g] = out.get(g, 0.0) + v
        norm = sum(v * v for v in out.values()) ** 0.5
        return {g: v / norm for g, v in out.items()}
    z = f"^{w}$"
    grams = {z[i : i + n] for n in (2, 3) for i in range(len(z) - n + 1)}
    return {**dict.fromkeys(grams, (0.7 / len(grams)) ** 0.5), "@" + w[0]: 0.3**0.5}


@lru_cache(maxsize=500_000)
def word_cosine(a: str, b: str) -> float:
    """Cosine of two words around the head; an acronym has one with itself only."""
    if a == b:
        return 1.0
    if "=" in (a[0], b[0]):
        return 0.0
    x, y = word_vector(a), word_vector(b)
    return sum(v * y[g] for g, v in x.items() if g in y)


def around_cosine(ra: list[str], rb: list[str]) -> float:
    """Cosine of what stands around two heads: the product over the words in order, 0 where only one side has any."""
    if ra == rb:
        return 1.0
    if not ra or not rb:
        return 0.0
    short = [r[0][0] == "=" for r in (ra, rb)]
    if any(short):
        letters = [sorted(r[0][1:]) if s else sorted(w[0] for w in r) for r, s in zip((ra, rb), short)]
        return ACRONYM if letters[0] == letters[1] else 0.0
    out = LEFT_OUT ** abs(len(ra) - len(rb))
    for x, y in zip(ra, rb):
        out *= word_cosine(x, y)
    return out


def spans_of(tasks: DataFrame) -> DataFrame:
    """Distinct ``id, text, label`` of all results of all predictions; null ids and texts drop out."""
    r = tasks.select(F.explode("predictions").alias("p")).select(F.explode("p.result").alias("r"))
    return r.select("r.id", F.col("r.value.text").alias("text"), F.get("r.value.labels", F.lit(0)).alias("label")).where("id is not null and text is not null").distinct()


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}]+"), lambda w: F.length(w) > 1))


def name_texts(spans: DataFrame) -> DataFrame:
    """The distinct texts that are names, whatever single labels say.

    Each word votes with the share of name labels among all other texts that
    hold it, so a wrong label does not count; only where no word occurs
    elsewhere do the text's own labels decide. Texts with digits or, in Latin script, without a capital
    are no names.
    """
    s = spans.where(~F.col("text").rlike("[0-9٠-٩]") & (F.col("text").rlike(r"\p{Lu}") | F.col("text").rlike(r"[ء-ي]")))
    v = s.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").isin(*NAME_LABELS).cast("int")).alias("k"))
    w = v.select("text", "n", "k", F.explode(_words(F.col("text"))).alias("w"))
    by = w.groupBy("w").agg(F.sum("k").alias("wk"), F.sum("n").alias("wn"))
    # a word of this text alone repeats only the text's own label
    told = F.when(F.col("wn") > F.col("n"), (F.col("wk") - F.col("k")) / (F.col("wn") - F.col("n")))
    vote = w.join(by, "w").groupBy("text").agg(F.avg(told).alias("words"), F.max(told).alias("best"), F.first("k").alias("k"), F.first("n").alias("n"))
    own = F.col("k") / F.col("n")
    # capitals already speak for a name; elsewhere the words have to
    said = F.when(F.col("text").rlike(r"\p{Lu}"), F.greatest(F.coalesce("best", own), own)).otherwise(F.coalesce("words", own))
    return vote.where(said >= 0.5).select("text")


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))]))
def _parsed(text: pd.Series) -> pd.DataFrame:
    got = [parse(t) for t in text]
    return pd.DataFrame({"kind": [k for k, _ in got], "words": [w for _, w in got]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _heads(kind: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([heads(k, list(w)) for k, w in zip(kind, words)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _around(kind: pd.Series, words: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([around(k, list(w), h) for k, w, h in zip(kind, words, head)])


@F.pandas_udf(T.DoubleType())
def _around_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([around_cosine(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def _vectors(words: DataFrame, lengths: tuple[int, ...], total: int) -> DataFrame:
    """``kind, word, v``: unit vectors of n-grams weighted by inverse document frequency, rare grams first."""
    z = "concat('^', word, '$')"
    grams = F.expr("array_distinct(concat(" + ", ".join(f"transform(sequence(1, greatest(length(word) + 3 - {n}, 1)), i -> substring({z}, i, {n}))" for n in lengths) + "))")
    g = words.select("kind", "word", F.explode_outer(grams).alias("g"))
    df = g.groupBy("kind", "g").agg(F.count(F.lit(1)).alias("df"))
    x = F.struct(F.log(F.lit(float(total + 1)) / F.col("df")).alias("w"), F.xxhash64("g").alias("g"))
    vec = g.join(df, ["kind", "g"]).groupBy("kind", "word").agg(F.sort_array(F.collect_list(x), asc=False).alias("v")).withColumn("norm", F.expr("greatest(sqrt(aggregate(v, 0D, (s, x) -> s + x.w * x.w)), 1e-9D)"))
    return vec.select("kind", "word", F.expr("transform(v, x -> struct(x.g as g, x.w / norm as w))").alias("v"))


def similar_words(words: DataFrame) -> DataFrame:
    """Pairs ``kind, a, b, cosine``, ``a < b``, of different words with a cosine of ``COSINE`` or more.

    ``words`` has unique ``kind, word``. The cosine is that of 2- and 3-grams.
    Words meet on a 4-gram or on what is left of them without one letter (so any
    two that are one typing error apart do). 4-grams are ordered from rare to
    common; the tail whose weights have a norm below the threshold cannot by
    itself lift a pair over it and is not joined.
    """
    total = max(words.count(), 1)
    # the square sum before each place tells where the rest falls below the threshold
    prefix = F.expr(
        f"aggregate(v, named_struct('s', 0D, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct('s', a.s + x.w * x.w, 'out', case when sqrt(greatest(1 - a.s, 0D)) >= {COSINE} then array_append(a.out, x.g) else a.out end), a -> a.out)"
    )
    less = F.expr("concat(array(xxhash64('-', word)), transform(sequence(1, length(word)), i -> xxhash64('-', concat(substring(word, 1, i - 1), substring(word, i + 1)))))")
    long = _vectors(words, (4,), total).select("kind", "word", F.explode(prefix).alias("k"))
    gapped = words.where("length(word) >= 3").select("kind", "word", F.explode(F.array_distinct(less)).alias("k"))
    keys = long.unionByName(gapped)
    met = keys.alias("l").join(keys.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("l.kind") == F.col("r.kind")) & (F.col("l.word") < F.col("r.word"))).select("l.kind", F.col("l.word").alias("a"), F.col("r.word").alias("b")).distinct()
    vec = cut(_vectors(words, (2, 3), total))
    both = met.join(vec.select("kind", F.col("word").alias("a"), F.col("v").alias("va")), ["kind", "a"]).join(vec.select("kind", F.col("word").alias("b"), F.col("v").alias("vb")), ["kind", "b"])
    dot = F.expr("aggregate(va, 0D, (s, x) -> s + x.w * coalesce(get(filter(vb, y -> y.g = x.g), 0).w, 0D))")
    return both.select("kind", "a", "b", dot.alias("cosine")).where(F.col("cosine") >= COSINE)


def similar_spellings(spellings: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs ``a, b, s`` of keys, ``a < b``, with a cosine ``s`` of ``PAIR`` or more.

    ``spellings`` has unique ``key, kind, head, rest``, ``near`` the pairs of
    similar heads. Spellings with the same or similar heads meet where the next
    words share one of their first two letters, or where the initials of one
    are the other's acronym.
    """
    first = "rest[0]"
    tags = F.expr(
        f"case when size(rest) = 0 then array() when startswith({first}, '=') then array(concat('#', array_join(array_sort(split(substring({first}, 2), '')), ''))) "
        f"else concat(array('@' || substring({first}, 1, 1)), case when length({first}) > 1 then array('@' || substring({first}, 2, 1)) else array() end, array(concat('#', array_join(array_sort(transform(rest, w -> substring(w, 1, 1))), '')))) end"
    )
    t = spellings.withColumn("tag", F.explode(F.array_distinct(tags)))
    pair = near.select("kind", F.col("a").alias("head"), F.col("b").alias("other"), "cosine")
    same = spellings.select("kind", "head", F.col("head").alias("other"), F.lit(1.0).alias("cosine")).distinct()
    heads_ = pair.unionByName(pair.select("kind", F.col("other").alias("head"), F.col("head").alias("other"), "cosine")).unionByName(same)
    left = t.join(heads_, ["kind", "head"]).select("kind", F.col("other").alias("head"), "tag", F.col("key").alias("a"), F.col("rest").alias("ra"), "cosine")
    right = t.select("kind", "head", "tag", F.col("key").alias("b"), F.col("rest").alias("rb"))
    met = left.join(right, ["kind", "head", "tag"]).where("a < b").groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"), F.max("cosine").alias("cosine"))
    bare = spellings.where("size(rest) = 0").select("kind", "head", F.col("key").alias("b"))
    alone = bare.join(heads_, ["kind", "head"]).select("kind", F.col("other").alias("head"), F.col("b").alias("a"), "cosine").join(bare, ["kind", "head"]).where("a < b").select("a", "b", F.col("cosine").alias("s"))
    return met.select("a", "b", (F.col("cosine") * _around_cosine("ra", "rb")).alias("s")).unionByName(alone).where(F.col("s") >= PAIR)


def average_linkage(nodes: DataFrame, links: DataFrame, least: float = LINK) -> DataFrame:
    """``key, cluster`` of all ``nodes`` (``key``): average-linkage clusters over ``links`` (``a, b, s``, ``a < b``; other pairs count 0).

    A round merges all pairs of clusters that are each other's top neighbour,
    ties settled by a hash of the pair. Average linkage is reducible: other
    merges cannot come between such a pair, so the clusters are those of the
    greedy sequence. It ends when no average reaches ``least``.
    """
    edges = cut_in_loop(links.select("a", "b", "s", F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")))
    out = nodes.select("key", F.col("key").alias("cluster"))
    while True:
        rated = edges.withColumn("at", F.struct((F.col("s") / (F.col("na") * F.col("nb"))).alias("avg"), F.xxhash64("a", "b").alias("tie"), "a", "b", (F.col("na") + F.col("nb")).alias("n")))
        top = rated.select(F.explode(F.array("a", "b")).alias("c"), "at").groupBy("c").agg(F.max("at").alias("at")).where(F.col("at.avg") >= least)
        pairs = cut_in_loop(top.groupBy("at").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("at.a", "at.b", "at.n"))
        if pairs.isEmpty():
            return out
        moved = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("to"), "n")
        out = out.join(pairs.select(F.col("b").alias("cluster"), F.col("a").alias("to")), "cluster", "left").select("key", F.coalesce("to", "cluster").alias("cluster"))
        e = edges.join(moved.select(F.col("c").alias("a"), F.col("to").alias("ta"), F.col("n").alias("ma")), "a", "left").join(moved.select(F.col("c").alias("b"), F.col("to").alias("tb"), F.col("n").alias("mb")), "b", "left")
        x = F.struct(F.coalesce("ta", "a").alias("c"), F.coalesce("ma", "na").alias("n"))
        y = F.struct(F.coalesce("tb", "b").alias("c"), F.coalesce("mb", "nb").alias("n"))
        e = e.select(F.least(x, y).alias("l"), F.greatest(x, y).alias("r"), "s").where("l.c != r.c")
        edges = cut_in_loop(e.groupBy(F.col("l.c").alias("a"), F.col("r.c").alias("b")).agg(F.sum("s").alias("s"), F.first("l.n").alias("na"), F.first("r.n").alias("nb")))


def clusters(texts: DataFrame) -> DataFrame:
    """``text, cluster`` for distinct name texts; one cluster per person or organisation.

    Spellings that are alike once brought to full forms are one node; what
    meets are nodes, so repeated spellings multiply nothing. Null texts drop out.
    """
    parsed = texts.where("text is not null").select("text", _parsed("text").alias("p")).select("text", "p.kind", "p.words").where(F.size("words") > 0)
    parsed = cut(parsed.withColumn("heads", _heads("kind", "words")))
    options = parsed.select("text", "kind", F.explode("heads").alias("word"))
    words = cut(options.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")))
    near = cut(similar_words(words))
    both = near.select("kind", F.col("a").alias("word"), F.col("b").alias("to")).unionByName(near.select("kind", F.col("b").alias("word"), F.col("a").alias("to")))
    more = both.join(words.select("kind", F.col("word").alias("to"), "n"), ["kind", "to"]).select("kind", "word", "n")
    weight = words.unionByName(more).groupBy("kind", "word").agg(F.sum("n").alias("all"))
    # of several possible heads, the rarest that stands in more than one spelling
    head = options.join(weight, ["kind", "word"]).groupBy("text").agg(F.min(F.struct((F.col("all") < 2).alias("lone"), "all", "word")).alias("h"))
    keyed = parsed.join(head, "text").select("text", "kind", F.col("h.word").alias("head"), _around("kind", "words", "h.word").alias("rest"))
    keyed = cut(keyed.withColumn("key", F.xxhash64("kind", "head", "rest")))
    spellings = keyed.select("key", "kind", "head", "rest").distinct()
    got = average_linkage(spellings.select("key"), similar_spellings(spellings, near))
    return keyed.select("text", "key").join(got, "key").select("text", "cluster")


def same_entity_pairs(tasks: DataFrame) -> DataFrame:
    """Pairs ``id_a < id_b`` of spans that name one person or organisation.

    Null or empty predictions give nothing; tasks stored twice count once;
    a span whose id stands with two texts belongs to both of their clusters.
    """
    spans = spans_of(tasks)
    c = clusters(name_texts(spans))
    m = spans.select("id", "text").join(c, "text").select("id", "cluster").distinct()
    return m.alias("x").join(m.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")).distinct()


def chunk_mentions(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunkId, start, end, text, cluster``: where the chunks themselves hold the names of spans.

    A span counts where its characters stand at its place in the chunk's text;
    tasks without a chunk, and places that differ, give nothing.
    """
    r = tasks.select("meta.chunkId", F.explode("predictions").alias("p")).select("chunkId", F.explode("p.result").alias("r"))
    s = r.select("chunkId", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"), F.col("r.value.text").alias("text")).where("chunkId is not null and text is not null").distinct()
    c = clusters(name_texts(spans_of(tasks)))
    t = chunks.select("chunkId", F.col("text").alias("body")).distinct()
    held = s.join(t, "chunkId").where(F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).drop("body")
    return held.join(c, "text").select("chunkId", "start", "end", "text", "cluster").distinct()
