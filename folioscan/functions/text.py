"""Column functions over page texts, all in the JVM, and the normaliser that Python functions share."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .patterns import CONTEXT, HYPHENATED, PREVIEW


def has(text: Column, *parts: str) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


#: What a text has if it has a match; far faster than the match. Where case doesn't count, parts are of letters that no sign beyond ASCII folds to (not i, k, s).
NEEDS = {
    P.UNRESOLVED: lambda t: has(t, "?"),
    P.DRAFT: lambda t: has(F.lower(t), "todo", "xme", "xxx", "tbd"),
    P.STUTTER: lambda t: has(t, ",,", ";;", ".."),
    P.ISOLATED: lambda t: t.rlike(r"(?U)[,;](?<!\S[,;])"),
    P.SMALL_FLOAT: lambda t: has(t, "fig", "table"),
    P.FIGURE: lambda t: has(t, "Fig"),
    P.TABLE: lambda t: has(t, "Table"),
    P.EMAIL: lambda t: has(t, "@"),
    P.ACKNOWLEDGMENT: lambda t: has(F.lower(t), "nowledg"),
}


def may_match(text: Column, pattern: str) -> Column:
    return NEEDS[pattern](text) if pattern in NEEDS else F.lit(True)


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.isNull() | may_match(text, pattern), found).otherwise(F.array().cast("array<string>")) if pattern in NEEDS else found


def occurrences(text: Column, pattern: str) -> Column:
    return F.coalesce(F.size(hits(text, pattern)), F.lit(0))


def matched(text: Column, pattern: str) -> Column:
    return may_match(text, pattern) & text.rlike(pattern)


def squeeze(text: Column) -> Column:
    """White space runs become one blank, and none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """text without white space at its ends; most has none there, which its first and last sign tell."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def dehyphenate(text: Column) -> Column:
    return F.when(text.rlike("[-\u00ad][ \\t]*\n"), F.regexp_replace(text, HYPHENATED, "")).otherwise(text)


def contexts(text: Column, pattern: str, limit: int = PREVIEW) -> Column:
    """The first matches with CONTEXT characters on either side.

    What lies between matches is what splitting by the pattern leaves, so an offset is the sum of the lengths before
    it; only the few that are shown are added up. Matches and rests are bound once, and only where there is a match.
    """

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))

    def shown(m: Column, i: Column) -> Column:
        start = total(F.slice(m.rests, 1, i + 1)) + total(F.slice(m.matched, 1, i))
        end = start + F.length(F.get(m.matched, i))
        first = F.greatest(start - CONTEXT, F.lit(0))
        return squeeze(F.substring(text, first + 1, end + CONTEXT - first))

    def some(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.least(F.size(m.matched), F.lit(limit)) - 1), lambda i: shown(m, i))

    bound = F.array(F.struct(F.slice(hits(text, pattern), 1, limit).alias("matched"), F.split(text, pattern, limit + 1).alias("rests")))
    return F.when(matched(text, pattern), F.get(F.transform(bound, some), F.lit(0))).otherwise(F.array().cast("array<string>"))


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum() or c.isspace())
