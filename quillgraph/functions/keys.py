"""Column expressions on record keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Java's ``\s`` leaves out, added for trimming.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]"


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def folded(c: Column) -> Column:
    """Key form that ignores letter case and outer blanks."""
    return F.lower(trimmed(c))


def split_key(c: Column) -> tuple[Column, Column]:
    """``(prefix, number)`` of a string key.

    The number is the run of at most 18 ASCII digits that ends the key (0 where
    there is none). The prefix is everything before it plus the width of that
    run, so ``a-1`` and ``a-01`` keep different prefixes and the pair is a
    one-to-one image of the key.
    """
    digits = F.regexp_extract(c, r"([0-9]{1,18})$", 1)
    width = F.length(digits)
    prefix = F.concat(F.substring(c, F.lit(1), F.length(c) - width), F.lit("\u0001"), width.cast("string"))
    number = F.when(width > 0, digits.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return prefix, number
