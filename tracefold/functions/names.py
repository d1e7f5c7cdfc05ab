"""Keys under which names are compared. All but the accent folding are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a name key drops at its end.
LEGAL_WORDS = ("pty", "ltd", "limited", "proprietary", "inc", "incorporated", "llc", "plc", "corp", "corporation", "co", "gmbh", "pte")
GENERIC_WORDS = (
    "group", "holdings", "labs", "lab", "technologies", "technology", "tech", "software", "systems",
    "solutions", "ventures", "global", "international", "australia", "aus", "au", "digital", "studio", "studios",
)

#: The least similarity of two names that are taken as spellings of one, and the shortest name for which that holds.
SIMILAR, SIMILAR_LENGTH = 0.84, 5


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks: the one step that Spark SQL has no function for."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not "̀" <= c <= "ͯ"))


def _words(name: Column, folded: bool) -> Column:
    """The words of a name, space-joined: no accents, no parentheses, no leading 'the'."""
    plain = F.lower(name if folded else fold(name))
    plain = F.regexp_replace(F.regexp_replace(plain, "&", " and "), r"\([^)]*\)", " ")
    plain = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^(?:the )+(?=.)", "")


def _without_tail(words: Column, tail: tuple[str, ...]) -> Column:
    return F.regexp_replace(words, f"(?: (?:{'|'.join(tail)}))+$", "")


def name_words(name: Column, folded: bool = False) -> Column:
    """array<string> of the words of a name, without a legal tail. folded: the name has no accents."""
    w = _without_tail(_words(F.coalesce(name, F.lit("")), folded), LEGAL_WORDS)
    return F.filter(F.split(w, " "), lambda x: x != "")


def name_key(name: Column, folded: bool = False) -> Column:
    """The name as one run of letters and digits, without a legal tail; at least one word stays."""
    return F.regexp_replace(_without_tail(_words(F.coalesce(name, F.lit("")), folded), LEGAL_WORDS), " ", "")


def loose_name_key(name: Column, folded: bool = False) -> Column:
    """Like name_key, without generic words at the end either."""
    return F.regexp_replace(_without_tail(_words(F.coalesce(name, F.lit("")), folded), LEGAL_WORDS + GENERIC_WORDS), " ", "")


def name_variants(name: Column) -> Column:
    """struct<primary, aliases, former>: what stands outside parentheses, and what inside names it otherwise or did before."""
    text = F.trim(F.coalesce(name, F.lit("")))
    inner = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), F.trim), lambda s: s != "")
    was = r"(?i)^(?:formerly|previously|ex|fka|f/k/a|was|née)\b[\s:.-]*(.+)$"
    aka = r"(?i)^(?:aka|a\.k\.a\.?|also known as|trading as|t/a)\b[\s:.-]*(.+)$"
    former = F.array_distinct(F.transform(F.filter(inner, lambda s: s.rlike(was)), lambda s: F.trim(F.regexp_extract(s, was, 1))))
    alias = F.array_distinct(F.transform(F.filter(inner, lambda s: ~s.rlike(was)), lambda s: F.when(s.rlike(aka), F.trim(F.regexp_extract(s, aka, 1))).otherwise(s)))
    outside = F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s+", " "))
    return F.struct(F.when(outside == "", text).otherwise(outside).alias("primary"), alias.alias("aliases"), former.alias("former"))


def bigrams(s: Column) -> Column:
    """array<string> of the overlapping pairs of characters, repeats included."""
    n = F.length(s)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared character pairs, with repeats, over all pairs."""
    ga, gb = bigrams(a), bigrams(b)
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    shared = F.aggregate(F.array_distinct(ga), F.lit(0), lambda acc, g: acc + F.least(count(ga, g), count(gb, g)))
    return 2.0 * shared / (F.length(a) + F.length(b) - 2)


def _dice(x: str | None, y: str | None) -> float:
    if x is None or y is None or len(x) + len(y) <= 2:
        return 0.0
    gx, gy = Counter(map(str.__add__, x, x[1:])), Counter(map(str.__add__, y, y[1:]))
    return 2 * sum((gx & gy).values()) / (len(x) + len(y) - 2)


@F.pandas_udf(T.DoubleType())
def dice_of_many(a: pd.Series, b: pd.Series) -> pd.Series:
    """`dice` for many pairs: the counting of repeats is quicker here than in nested array functions."""
    return pd.Series([_dice(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dices_of_names(a: pd.Series, b: pd.Series) -> pd.Series:
    """`dice` of each name of the one list with each of the other, row by row of the table that they make."""
    none: tuple[str, ...] = ()
    lists = ((none if x is None else x, none if y is None else y) for x, y in zip(a, b, strict=True))
    return pd.Series([[_dice(x, y) for x in xs for y in ys] for xs, ys in lists], dtype="object")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal keys, else the share of characters that stay under the fewest edits, or Dice of two keys of six or more if larger."""
    edit = 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    value = F.when((F.length(a) < 6) | (F.length(b) < 6), edit).otherwise(F.greatest(edit, dice(a, b)))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).otherwise(value)


def slug(name: Column, folded: bool = False) -> Column:
    """Lower-case words joined by hyphens; parentheses go unless nothing else is there."""
    outside = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    s = F.when(outside == "", name).otherwise(outside)
    s = F.regexp_replace(F.lower(s if folded else fold(s)), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tight(text: Column) -> Column:
    """Only the letters a-z and the digits, lower-cased: spacing and punctuation do not count."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def person_key(name: Column, folded: bool = False) -> Column:
    """Two words at least, letters, hyphens and apostrophes only; null for a single word."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name if folded else fold(name)), "[^a-z\\s'-]", " "), r"\s+", " "))
    return F.when(F.instr(s, " ") > 0, s)


def city_key(city: Column, folded: bool = False) -> Column:
    """The city without parentheses and punctuation; null for none and 'unknown'."""
    s = F.regexp_replace(F.lower(city if folded else fold(city)), r"\s*\([^)]*\)", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z\s]", " "), r"\s+", " "))
    return F.when((s != "") & (s != "unknown"), s)
