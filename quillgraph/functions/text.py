"""Text and id expressions; all of them run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blocks(markdown: Column) -> Column:
    """Parts between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(markdown, r"\n\s*\n"), strip), lambda b: b != "")


def block_kind(block: Column) -> Column:
    """heading, table, list or paragraph."""
    return F.when(F.startswith(block, F.lit("#")), "heading").when(F.startswith(block, F.lit("|")), "table").when(F.substring_index(block, "\n", 1).rlike(r"^([-*+]|[0-9]+\.)\s"), "list").otherwise("paragraph")


def heading_level(block: Column) -> Column:
    return F.length(F.regexp_extract(block, "^(#+)", 1))


def heading_text(block: Column) -> Column:
    return strip(F.regexp_replace(block, "^#+", ""))


def element_id(doc: Column, n: Column) -> Column:
    return F.format_string("%s-%04d", doc, n)


def chunk_id(doc: Column, n: Column) -> Column:
    return F.format_string("%s-c%04d", doc, n)


def normalize_arabic(c: Column) -> Column:
    """Without vowel marks, alef and yeh in one form, single blanks, trimmed."""
    return strip(F.regexp_replace(F.translate(F.regexp_replace(c, "[ً-ٟ]", ""), "أإآى", "اااي"), r"\s+", " "))


def normalize_for_lookup(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[\u0610-\u061a\u064b-\u065f]", ""), "أإآى", "اااي")



def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"\s+", "-"))


def canonical_key(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def link_name(c: Column) -> Column:
    """Upper-case identifier of a relationship; LINKED_TO where nothing is left."""
    n = F.upper(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(n, F.lit("")), F.lit("LINKED_TO"))


def count_tokens(c: Column) -> Column:
    """Number of white-space separated words."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def truncate_tokens(c: Column, budget: int) -> Column:
    """Unchanged within the budget, else its first words."""
    return F.when(count_tokens(c) <= budget, F.coalesce(c, F.lit(""))).otherwise(F.array_join(F.slice(F.split(strip(c), r"\s+"), 1, budget), " "))


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?<=[.!?؟])\s+"), lambda s: strip(s) != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def arabic_share(c: Column) -> Column:
    """Arabic characters among alphabetic ones; null without any."""
    return F.regexp_count(c, F.lit("[؀-ۿ]")) / F.nullif(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(0))


def has_pii(c: Column) -> Column:
    return c.rlike(r"\b[0-9]{10,}\b")


def char_ngrams(c: Column) -> Column:
    """Distinct 2- and 3-grams with their prefixes."""
    grams = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.concat(F.lit(f"c{n}_"), F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(grams(2), grams(3)))


def script_features(c: Column) -> dict[str, Column]:
    return {
        "is_arabic_num": c.rlike("^[٠-٩]+$"), "is_western_num": c.rlike("^[0-9]+$"), "contains_latin": c.rlike("[a-zA-Z]"), "is_clause_ref": c.rlike("^[0-9٠-٩]+-[0-9٠-٩]+(-[0-9٠-٩]+)*$"), "is_abbreviation": c.rlike("^[A-Z]{2,6}$"),
    }


# Joined prefixes before single ones.
PREFIXES, CLITICS = ("بال", "لل", "كال", "وال", "فال"), ("ب", "ل", "ك", "و", "ف")


def morph_features(c: Column) -> dict[str, Column]:
    """Proclitic, definite article and stem of an Arabic word; the longest prefix goes first."""
    anything = "^(" + "|".join([*PREFIXES, *CLITICS]) + ")"
    stem = c
    for p in reversed(CLITICS):
        stem = F.when(F.startswith(c, F.lit(p)) & (F.length(c) > len(p) + 1), F.substring(c, F.lit(len(p) + 1), F.length(c))).otherwise(stem)
    for p in reversed(PREFIXES):
        stem = F.when(F.startswith(c, F.lit(p)), F.substring(c, F.lit(len(p) + 1), F.length(c))).otherwise(stem)
    article = F.startswith(stem, F.lit("ال"))
    return {"has_def_art": article, "has_prep_clitic": c.rlike(anything), "stem": F.when(article, F.substring(stem, F.lit(3), F.length(stem))).otherwise(stem)}


def embed_text(name: Column, aliases: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(name), aliases), lambda x: x.isNotNull() & (x != ""))), " / ")


def context_block(chunk: Column, path: Column, pages: Column, body: Column) -> Column:
    return F.concat(F.lit("["), chunk, F.lit(" | section: "), F.array_join(path, " > "), F.lit(" | pages: "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("]\n"), body)


def safe_name(url: Column) -> Column:
    """File name of a URL's last path segment."""
    return F.regexp_replace(F.url_decode(F.regexp_extract(url, "([^/]*)$", 1)), "[^A-Za-z0-9_.\\-؀-ۿ]+", "_")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def is_pdf(url: Column) -> Column:
    u = F.substring_index(F.lower(url), "?", 1)
    return ~u.rlike(r"\.(png|jpg|jpeg|gif|svg)") & (F.endswith(u, F.lit(".pdf")) | F.contains(u, F.lit("/-/media/")))


def next_page(url: Column) -> Column:
    """The URL with its pageNo raised by one; null without one."""
    n = F.regexp_extract(url, "pageNo=([0-9]+)", 1)
    return F.when(n != "", F.concat(F.regexp_extract(url, "^(.*?pageNo=)[0-9]+", 1), (n.cast("bigint") + 1).cast("string"), F.regexp_extract(url, "pageNo=[0-9]+(.*)$", 1)))
