"""Defective prompt and response pairs (problem 3).

Answers that directly follow a question are judged by a script and function
word check against the question's language (or the one it asks for), a grammar
of refusals over all sentences, a pushdown parser of fences, brackets,
quotations, markup and lists for unfinished text, and greedy string tiling
against the question. Built-in expressions decide whatever a pattern can
decide and pick out the few answers that need the parser or the tiling; those
go to Arrow-batched Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import conversations as CV
from quillgraph.llm import languages as L
from quillgraph.llm import lookalikes as LA
from quillgraph.runtime import cut

#: Share of a candidate's words that the tiles must cover, of the answer and of the question.
COPY_ANSWER, COPY_QUESTION = 0.8, 0.8

# The refusal grammar, an optional apology is no evidence by itself.
_EN_ABLE = r"(?:can(?:not|'t|no)|(?:wo|would|could)n't(?: be able to)?|(?:will|would|could|may|must|am|do|did|be) not(?: be)?(?: able to| allowed to| permitted to| in a position to| going to)?|(?:am|be) unable to|am not (?:able|allowed|permitted|in a position) to|must decline to|(?:have|need) to decline to|decline to|refuse to|prefer not to)"
_EN_ACT = r"(?:say|answer|help|comment|repl(?:y|ies)|discuss|assist|provide|respond|speak|talk|tell|give (?:an?|any|you)|share|advise|comply|fulfil|address|deal with)"
REFUSALS_EN = [
    rf"\bi {_EN_ABLE} (?:\w+ )?{_EN_ACT}\b",
    rf"\bi(?:'m| am) (?:not able|unable|not allowed|not permitted|not in a position) to (?:\w+ )?{_EN_ACT}\b",
    r"\bi (?:must|have to|will) (?:leave|decline) (?:this|the|that|your) (?:question|request)\b",
    r"\b(?:not a (?:subject|topic|matter|question) (?:that )?i (?:may|can|am allowed to))\b",
    r"\b(?:beyond|outside) my (?:remit|scope|mandate|competence)\b",
    r"\b(?:beyond|outside) the (?:remit|scope|mandate|competence)\b",
    r"\b(?:nothing|none of what) (?:that )?i (?:was|have been) (?:shown|given)\b",
    r"\bi (?:have|see|find|found) no (?:basis|grounds|information|answer|passage|way)\b",
    r"\b(?:passages?|texts?|documents?|sources?)(?: \w+){0,3} (?:is|are) silent\b",
    r"\bno (?:reply|answer|response) can be given\b",
    r"\bi (?:could not|couldn't|did not|didn't|cannot|can't) find (?:any|an|the)\b",
]
REFUSALS_AR = [
    r"لا (?:يسعني|يمكنني|أستطيع|استطيع|يحق لي|يجوز لي|أملك|يتاح لي|أقدر)",
    r"(?:لن|لم|لست) (?:أتمكن|أستطيع|يسعني|يمكنني|قادرا|مخولا|أجد)",
    r"تتجاوز نطاق|خارج نطاق (?:عملي|صلاحيتي|اختصاصي)|لا يحق لي تناوله",
    r"(?:المقاطع|النصوص|الوثائق|المستندات المتاحة) صامتة",
    r"ليس لدي (?:أساس|ما|معلومات|إجابة|جواب|رد)",
    r"لا شيء مما عرض علي",
    r"لا رد لدي|(?:أعتذر|اعتذر|نعتذر) عن (?:الإجابة|الرد|عدم)|أترك هذا السؤال|ترك هذا السؤال|بلا (?:جواب|إجابة|رد)|دون (?:جواب|إجابة)|لا (?:جواب|إجابة|رد) (?:يمكن|على|عن)|يتعذر علي|تعذر (?:علي|الرد|العثور)|لا تتوفر لدي|أمتنع عن",
]
# What languages are called in English and Arabic.
_NAMES = {
    "ar": ("arabic", "ال?عربية"), "en": ("english", "ال?[إا]نجليزية|ال?[إا]نكليزية"), "fr": ("french", "ال?فرنسية"), "de": ("german", "ال?[أا]لمانية"),
    "es": ("spanish", "ال?[إا]سبانية"), "it": ("italian", "ال?[إا]يطالية"), "pt": ("portuguese", "ال?برتغالية"),
}


def plain_form(c: Column) -> Column:
    """Look-alike letters, full-width forms and odd spaces replaced one by one, invisible characters dropped."""
    wide = {chr(n + 0xFEE0): chr(n) for n in range(0x21, 0x7F)}
    spaces = {chr(n): " " for n in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    one = {k: v for k, v in {**wide, **LA.GREEK, **LA.CYRILLIC, **LA.OTHER, **spaces, "’": "'"}.items() if len(v) == 1}
    out = F.regexp_replace(F.translate(c, "".join(one), "".join(one.values())), "[\\u00ad\\u200b-\\u200f\\u2060-\\u2064\\ufeff]", "")
    return F.when(LA.maybe_odd(c), out).otherwise(F.replace(c, F.lit("\u2019"), F.lit("'")))


def with_language(df: DataFrame, c: str, out: str) -> DataFrame:
    """Column ``out``: ar, a language in Latin script by its function words, or other; null without letters.

    Bracketed and quoted parts (citations, terms) count only where nothing else
    is left. Every step is a column of its own, so that none is worked out
    twice. Further columns are kept: ``<out>_w``, the lower-cased words of the
    part that counts, and whether it holds Arabic and Latin letters.
    """
    bare = F.regexp_replace(c, r"\[[^\]]*\]?|«[^»]*»?|\([^)]*\)?", " ")
    df = df.withColumn("_b", F.when(F.col(c).rlike(r"[\[«(]"), bare).otherwise(F.col(c)))
    df = df.withColumn("_t", F.lower(F.when(F.col("_b").rlike(r"\p{L}"), F.col("_b")).otherwise(F.col(c))))
    # letters are counted by taking out the runs of everything else, which is several times faster than matching each
    left = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    df = df.withColumns({"_ar": left(r"[^ؠ-ي]+"), "_la": left(r"[^a-zà-ɏ]+"), "_le": left(r"\P{L}+")})
    df = df.withColumn(f"{out}_w", F.filter(F.split("_t", r"[^\p{L}\p{M}]+"), lambda w: w != ""))
    latin = (F.col("_la") * 2 >= F.col("_le")) & (F.col("_le") > 0)
    lang = F.when(F.col("_le") == 0, F.lit(None).cast("string")).when(F.col("_ar") * 2 > F.col("_le"), "ar").when(latin, L.latin_language(F.col(f"{out}_w"))).otherwise("other")
    return df.withColumns({out: lang, f"{out}_ar": F.col("_ar") > 0, f"{out}_la": F.col("_la") > 0}).drop("_b", "_t", "_ar", "_la", "_le")


def asked_language(c: Column) -> Column:
    """The language that a question asks its answer to be in; null if none."""
    out = F.lit(None).cast("string")
    for code, (english, arabic) in _NAMES.items():
        said = c.rlike(rf"(?i)\b(?:answer|reply|respond|write|response|explain)\w*\b[^.?!؟]{{0,40}}\bin(?:to)? {english}\b|\({{0,1}}\bin {english}(?:,? please)?[).?!]*\s*$") | c.rlike(rf"(?:أجب|اجب|الرد|رد|اكتب|الإجابة|الاجابة|أجيبوا|الجواب|اشرح)[^.؟!]{{0,30}}\s(?:ب|باللغة |بال)(?:{arabic})")
        out = F.when(said, code).otherwise(out)
    return F.when(c.rlike("(?i)" + "|".join(f"{e}|{a}" for e, a in _NAMES.values())), out)


def refuses(c: Column, arabic: Column, latin: Column) -> Column:
    """Does an answer (in lower case) decline? Judged by all of its sentences, whatever their number.

    It does if one of the first two sentences declines in the writer's own
    name, or if at least half of all sentences, without
    questions back and advice where to ask, decline in any way. Only patterns of scripts
    that the answer holds are tried.
    """
    every, own = "|".join(REFUSALS_EN + REFUSALS_AR), "|".join(x for x in REFUSALS_EN + REFUSALS_AR if x not in _IMPERSONAL)
    parts = F.filter(F.split(c, r"(?<=[.!?؟])\s+|\s*\n\s*"), lambda x: x.rlike(r"\p{L}"))
    declines = F.transform(parts, lambda x: x.rlike(every))
    first = F.exists(F.slice(parts, 1, 2), lambda x: x.rlike(own))
    share = F.size(F.filter(declines, lambda x: x)) * 2 >= F.size(F.filter(parts, lambda x: x.rlike(every) | ~x.rlike(_COURTESY)))
    any_ = (latin & c.rlike("|".join(REFUSALS_EN))) | (arabic & c.rlike("|".join(REFUSALS_AR)))
    return F.when(any_, first | share).otherwise(F.lit(False))


#: Patterns that a text may also use of its subject, not of itself.
_IMPERSONAL = (REFUSALS_EN[5], REFUSALS_EN[8])
#: Sentences of a refusal that say nothing on the subject: questions back and advice where to ask.
_COURTESY = r"[?؟]\s*$|^\s*(?:please|kindly|you (?:may|could|can) (?:ask|try|contact)|من فضلك|يرجى|نرجو|أرجو|برجاء)(?!\p{L})"

_CLOSE = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_ITEM = re.compile(r"^\s*(?:[-*+•–□▪◦]|\(?[0-9٠-٩]{1,3}[.)]|\(?[^\W\d_][.)])(?:\s+|$)")
_TAIL = re.compile(r"\s*(?:\[[^\[\]]*\]|\([^()]*\)|«[^«»]*»)\s*[.]?\s*$")
_STOP = re.compile(r"[.!?؟۔][\"'”»)\]*_]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")


# Elements of markup that have no end, and those whose end may be left out.
_VOID = set("br hr img input meta link col wbr area base source".split())
_LOOSE = set("li p td th tr dt dd option thead tbody".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>")


def _open_markup(t: str) -> bool:
    """Is an element of markup left open, or a tag unfinished? A text without a whole tag has no markup."""
    stack: list[str] = []
    whole = False
    for g in _TAG.finditer(t):
        whole = True
        end, name, alone = g.group(1), g.group(2).lower(), g.group(3)
        if name in _VOID or alone:
            continue
        if not end:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return any(x not in _LOOSE for x in stack) or whole and re.search(r"</?[a-zA-Z][^<>]*$", t) is not None


def _open_list(lines: list[str]) -> bool:
    """Does a list stop early: an item announced by the last line, or a level opened by a colon that holds nothing?"""
    stack: list[int] = []  # indents of the open levels
    for x in lines:
        g = _ITEM.match(x)
        if not g:
            continue
        indent = len(x) - len(x.lstrip())
        while stack and indent < stack[-1]:
            stack.pop()
        if not stack or indent > stack[-1]:
            stack.append(indent)
    last = lines[-1]
    g = _ITEM.match(last)
    if not g or not stack:
        return False
    body = last[g.end() :].strip()
    return not body or body[-1] in ",،:;؛-–("


def unfinished(text: str) -> bool:
    """Does the text stop inside a fence, bracket, quotation, emphasis, markup, list or sentence?

    A pushdown parse: openers are pushed, a closer pops its opener (a closer
    without one, as in ``1)``, is passed over), and what is left on the stack
    at the end is unfinished. The last line then has to be a whole list item of
    any level, a whole table row, an end tag, or end a sentence; citations after
    the sentence are passed over. One or two words are never unfinished.
    """
    t = text.rstrip(" \t\r\n\u200b\u200c\u200d\ufeff\u00a0")
    if not t:
        return False
    if t.count("```") % 2:
        return True
    plain = re.sub(r"```.*?```", "", t, flags=re.S)
    if "<" in plain:
        if _open_markup(plain):
            return True
        plain = _TAG.sub("", plain)
    if plain.count("**") % 2 or plain.count("`") % 2:
        return True
    stack: list[str] = []
    for ch in plain:
        if ch in "([{«“":
            stack.append(ch)
        elif ch in _CLOSE:
            if stack and stack[-1] == _CLOSE[ch]:
                stack.pop()
        elif ch == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(ch)
    if stack:
        return True
    if t.endswith("```") or re.search(r"</[a-zA-Z][a-zA-Z0-9]*\s*>$", t):
        return False
    lines = t.split("\n")
    last = lines[-1].strip()
    if _ITEM.match(lines[-1]):
        return _open_list(lines)
    if last.startswith("|"):
        return not last.endswith("|")
    if _ELLIPSIS.search(t):
        return True
    while True:
        cut = _TAIL.sub("", t)
        if cut == t or not cut.strip():
            break
        if _STOP.search(t) and not t.endswith((")", "]", "»")):
            break
        t = cut.rstrip()
    return not _STOP.search(t) and len(t.split()) > 2


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _hashes(codes: list[int], n: int) -> list[int]:
    """Rolling hashes of all runs of ``n``."""
    if len(codes) < n:
        return []
    top, h, out = pow(_BASE, n - 1, _MOD), 0, []
    for i, x in enumerate(codes):
        if i >= n:
            h = (h - codes[i - n] * top) % _MOD
        h = (h * _BASE + x) % _MOD
        if i >= n - 1:
            out.append(h)
    return out


def tiles(a: list[str], b: list[str], least: int = 3) -> tuple[int, int]:
    """Greedy string tiling: words of ``a`` and of ``b`` covered by common runs.

    Runs have at least ``least`` words (or all of ``b``); a word belongs to one
    tile of ``a``, while ``b`` may be used again once all of it is used up.
    Running hashes find the runs, long ones first: each level halves the
    length that a run must have, is extended as far as it goes, and takes time
    in proportion to the words.
    """
    least = min(least, max(1, len(b)))
    code: dict[str, int] = {}
    ca, cb = ([code.setdefault(w, len(code) + 1) for w in x] for x in (a, b))
    free_a, free_b, used_b = [True] * len(a), [True] * len(b), [False] * len(b)
    levels = [least]
    while levels[0] * 2 <= min(len(a), len(b)):
        levels.insert(0, levels[0] * 2)
    while True:
        found = False
        for n in levels:
            at: dict[int, list[int]] = {}
            for j, h in reversed(list(enumerate(_hashes(cb, n)))):
                at.setdefault(h, []).append(j)
            hashes, i = _hashes(ca, n), 0
            while i < len(hashes):
                starts = at.get(hashes[i])
                if not starts or not free_a[i] or not free_a[i + n - 1]:
                    i += 1
                    continue
                while starts and not (free_b[starts[-1]] and free_b[starts[-1] + n - 1]):
                    starts.pop()
                if not starts:
                    i += 1
                    continue
                j, k = starts.pop(), 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and ca[i + k] == cb[j + k]:
                    k += 1
                if k < n:
                    i += 1
                    continue
                found = True
                free_a[i : i + k] = [False] * k
                free_b[j : j + k] = [False] * k
                used_b[j : j + k] = [True] * k
                i += k
        if not found or not any(free_a):
            break
        if any(free_b):
            break
        free_b = [True] * len(b)
    return free_a.count(False), used_b.count(True)


_WORD = re.compile(r"[^\W_]+")


def copies(answer: str, question: str) -> bool:
    """Nothing but the question: its words, perhaps twice or after a lead of at most three words."""
    a, q = _WORD.findall(answer.lower()), _WORD.findall(question.lower())
    if not a or not q:
        return False
    if a == q:
        return True
    in_a, in_q = tiles(a, q)
    lead = len(a) - in_a
    if lead > max(3, 0.05 * len(a)) or in_a < 0.6 * len(a):
        return False
    if in_q >= COPY_QUESTION * len(q):
        return True
    final = _WORD.findall(re.split(r"(?<=[.!?؟])\s+", question.strip().lower())[-1])
    return len(final) >= 4 and len(a) >= len(final) and tiles(final, a)[0] >= 0.95 * len(final)


@F.pandas_udf(T.BooleanType())
def _unfinished(text: pd.Series) -> pd.Series:
    return text.map(unfinished)


@F.pandas_udf(T.BooleanType())
def _copies(answer: pd.Series, question: pd.Series) -> pd.Series:
    return pd.Series([copies(a, q) for a, q in zip(answer, question)], dtype=bool)


def defects_of(pairs: DataFrame) -> DataFrame:
    """``id, defect`` of the pairs ``id, question, answer``; sound pairs give no row.

    A null answer is empty; without a question (null, or no letters) neither
    copy nor language can be said. Empty excludes all else, copy all but
    itself, a refusal is not also truncated.
    """
    p = pairs.select("id", plain_form(F.coalesce("question", F.lit(""))).alias("q"), plain_form(F.coalesce("answer", F.lit(""))).alias("a"))
    p = with_language(with_language(p, "a", "la"), "q", "lq")
    # whatever its length: an answer may repeat the question many times; the tiling decides on all words, digits and brackets included
    kinds = F.size(F.array_distinct("la_w"))
    maybe_copy = F.coalesce(F.col("lq").isNotNull() & (kinds <= 2 * F.size("lq_w") + 3) & (F.size(F.array_intersect("la_w", "lq_w")) >= 0.5 * kinds), F.lit(False))
    # complete without parsing: ends a sentence, and nothing that could be open
    sure = F.col("a").rlike(r"[.!?؟]\s*$") & ~F.col("a").rlike(r"[\[({«“\"`]|(\.\.\.|…)\s*$|\n\s*\S{1,4}[.)]\s*$|<|\*\*")
    judged = p.select(
        "id", "a", "q", (~F.col("a").rlike(r"[\p{L}\p{N}]")).alias("is_empty"), maybe_copy.alias("maybe_copy"), sure.alias("sure"), refuses(F.lower("a"), F.col("la_ar") | F.col("a").rlike("[\\[«(]"), F.col("la_la") | F.col("a").rlike("[\\[«(]")).alias("no"), "la", F.coalesce(asked_language(F.col("q")), F.col("lq")).alias("lq")
    )
    hard = "not is_empty and (maybe_copy or not sure)"
    # written once: all three branches below read these figures, and only the hard answers keep their texts
    judged = cut(judged.select("id", "is_empty", "maybe_copy", "no", "la", "lq", F.expr(f"case when {hard} then a end").alias("a"), F.expr("case when maybe_copy then q end").alias("q")))
    empty = judged.where("is_empty").select("id", F.lit("empty").alias("defect"))
    simple = judged.where("not is_empty and a is null").withColumns({"copy": F.lit(False), "open": F.lit(False)})
    hard = judged.where("a is not null").withColumns({"copy": F.col("maybe_copy") & _copies(F.col("a"), F.coalesce("q", F.lit(""))), "open": _unfinished("a")})
    cols = ["id", "no", "la", "lq", "copy", "open"]
    all_ = simple.select(cols).unionByName(hard.select(cols))
    found = F.array_compact(
        F.when(F.col("copy"), F.array(F.lit("copy"))).otherwise(
            F.array(
                F.when(F.col("no"), F.lit("refusal")),
                F.when(F.col("open") & ~F.col("no"), F.lit("truncated")),
                F.when(F.col("la") != F.col("lq"), F.lit("language")),
            )
        )
    )
    return empty.unionByName(all_.select("id", F.explode_outer(found).alias("defect")).where("defect is not null")).distinct()


def pair_defects(messages: DataFrame) -> DataFrame:
    """Defects of all question and answer pairs in a table of messages."""
    return defects_of(CV.question_answer_pairs(messages))
