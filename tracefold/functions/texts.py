"""Short texts that people write or read: the line of a card, what two descriptions share, what a form accepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = 170
CLIP = 300
# Words that every description has.
COMMON = (
    "australia", "australian", "western", "perth", "startup", "startups", "company", "platform", "business", "businesses", "based", "their", "which", "about", "helping", "building", "provide",
    "provides", "solutions", "solution", "technology", "technologies", "services", "service", "software", "product", "products", "customers", "people", "founder", "founders", "program",
    "programme", "cohort", "accelerate", "accelerator", "venture", "ventures", "digital", "online", "future", "world", "every", "where", "while", "across", "these", "those", "through", "using",
    "other", "between", "curtin", "spacecubed", "eight", "welcome", "home", "learn", "contact", "launching", "soon",
)


def first_sentence(text: Column, most: int = LINE) -> Column:
    """The first sentence on one line; one that is longer than `most` ends at a word, with an ellipsis. '' for no text."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    # possessive: a text of any length without an end must not recurse
    first = F.regexp_extract(plain, r'^(?:[^.!?]|[.!?](?!\s+[A-Z0-9"“(]|$))*+[.!?](?=\s+[A-Z0-9"“(]|$)', 0)
    first = F.when(first == "", plain).otherwise(first)
    cut = F.substring(first, 1, most - 1)
    last = F.length(cut) - F.coalesce(F.nullif(F.instr(F.reverse(cut), " "), F.lit(0)), F.length(cut) + 1)
    ended = F.when(last > 40, F.left(cut, last)).otherwise(cut)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.regexp_replace(ended, r"[,;:\s]+$", ""), F.lit("…")))


def card_place(suburb: Column, city: Column) -> Column:
    """'Suburb, City', or the one that is known; a suburb that is the city is said once."""
    said = lambda c: F.when(~F.lower(F.trim(c)).isin("", "unknown"), c)
    return F.concat_ws(", ", F.when(~said(suburb).eqNullSafe(said(city)), said(suburb)), said(city))


def distinctive_words(text: Column) -> Column:
    """Runs of five letters or more, without the words that every description has; each once."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda w: ~w.isin(*COMMON)))


def shared_words(a: Column, b: Column) -> Column:
    """Distinctive words of both texts, in the order of the first."""
    return F.array_intersect(distinctive_words(a), distinctive_words(b))


def clip(text: Column, most: int = CLIP) -> Column:
    """At most so many characters, the last three of a longer text as dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def changes(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """array<struct<field, from, to>> of the fields that differ, by their JSON text, clipped."""
    text = lambda c: F.to_json(F.struct(c.alias("v")))  # noqa: E731  a null has no place in it, so null equals null
    row = lambda f: F.struct(F.lit(f).alias("field"), clip(before[f].cast("string")).alias("from"), clip(after[f].cast("string")).alias("to"))
    return F.array_compact(F.array(*[F.when(text(before[f]) != text(after[f]), row(f)) for f in before]))


def link_count(text: Column) -> Column:
    """How many web addresses a text holds."""
    return F.regexp_count(text, F.lit(r"(?i)(?:https?://|www\.)\S+"))


def looks_like_email(text: Column) -> Column:
    return F.coalesce((F.length(text) <= 254) & text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), F.lit(False))


def initials(name: Column) -> Column:
    """The first letters of the first two words, in capitals."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def clean_line(text: Column) -> Column:
    """One line without control and invisible characters, white space as one space."""
    seen = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]", "")
    return F.trim(F.regexp_replace(seen, r"\s+", " "))
