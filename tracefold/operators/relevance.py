"""Is a candidate Australian, and is it a startup: signals with weights, what they come to, and where a candidate goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.addresses import STATES
from tracefold.functions.headlines import investors_in
from tracefold.functions.registry_numbers import is_abn, is_acn
from tracefold.operators.imports import sum_signals

# From where on a sum of signals says yes, likely and no.
LEAST = {"australian": (0.6, 0.3, -0.2), "startup": (0.5, 0.2, -0.2)}
# Words and patterns of the signals.
CITIES = "Sydney|Melbourne|Brisbane|Perth|Adelaide|Canberra|Hobart|Darwin|Gold Coast|Newcastle|Wollongong|Geelong"
PTY_LTD = r"(?i)\bPty\.?\s+(?:Ltd|Limited)\b"
AT_HOME = rf"\b(?:Australian|Aussie|Australia)\b|\b(?:{CITIES})[- ](?:based|founded|headquartered)\b"
FOREIGN_DOMAIN = r"(?i)\.(?:co\.uk|uk|de|fr|nl|ie|es|it|se|no|dk|fi|ch|at|be|pl|ca|us|in|sg|hk|jp|kr|cn|br|mx|za|ae|il|nz)$"
FOREIGN_ADDRESS = (r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b", r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", r"\bNew Zealand\b")
FOREIGN_SEAT = r"(?i)\b(?:US|U\.S\.|American|UK|British|Singapore|New Zealand|Kiwi|San Francisco|New York|London|Silicon Valley|Auckland|Wellington)[- ]based\b"
FUNDING = (
    r"(?i)\b(?:raises?|raised|secures?|secured|closes?|closed|lands?|landed|grabs?|bags?|banks?|pockets?|nabs?|snags?|nails?|cements?)\b[^.]{0,40}?(?:A\$|US\$|\$|£|€)\s?\d"
    r"|\b(?:pre-?seed|seed round|series\s+[a-e]|funding round|venture capital|backed by|investment from|capital raise)\b"
)
STARTUP_WORDS = (
    r"\b(?:start-?ups?|scale-?ups?|co-?founders?|founders?|saas|platform|app|marketplace|AI|machine learning|deep ?tech|fintech|health ?tech|climate ?tech|ag ?tech|edtech|proptech|API|software)\b"
)
FUND = r"(?i)\b(?:debut|new|first|second|third|maiden)\s+(?:venture\s+)?fund\b|\b(?:ventures|capital|partners|investments|equity|fund)$"
ORDINARY = (
    r"(?i)\b(?:franchis(?:e|es|ing)|plumb(?:er|ers|ing)|electricians?|restaurants?|caf[eé]s?|bakery|butcher|dentists?|dental clinic|law firm|solicitors|accountants?|accounting firm|"
    r"real estate agen(?:cy|t)|estate agents?|builders?|landscap(?:er|ing)|cleaning services?|mechanics?|hairdress(?:er|ing)|beauty salon|gym|childcare|supermarket)\b"
)
ESTABLISHED = r"(?i)\b(?:ASX[- ]listed|listed on the ASX|founded in (?:18|19)\d{2}|since (?:18|19)\d{2}|family[- ]owned)\b"
PUBLIC_BODY = r"(?i)\b(?:council|university|department of|charity|not-for-profit|school)\b"
YOUNG_YEARS = 12


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _hit(text: Column, *patterns: str) -> Column:
    """The first match of the first pattern that has one; null for none."""
    found = [F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in patterns]
    return F.coalesce(*found)


def _signals(parts: list[tuple[str, float, Column]]) -> Column:
    """array<struct<code, weight, detail>> of the signals whose detail is not null."""
    each = [F.when(detail.isNotNull(), F.struct(F.lit(code).alias("code"), F.lit(float(weight)).alias("weight"), F.substring(detail, 1, 60).alias("detail"))) for code, weight, detail in parts]
    return F.array_compact(F.array(*each))


def australian() -> Column:
    """The signals of a subject for and against its being Australian."""
    address, said = _text("address"), F.concat_ws(" ", _text("address"), _text("text"))
    local = address.rlike(rf"\b(?:{'|'.join(STATES)})\s+\d{{4}}\b")
    placed = _text("state").isin(*STATES) & (_text("city") != "") & (F.lower(_text("city")) != "unknown")
    names = F.concat(F.array(_text("name")), F.coalesce("aliases", F.array().cast("array<string>")))
    return _signals([
        ("au_domain", 0.35, F.when(_text("domain").rlike(r"(?i)\.au$"), F.col("domain"))),
        ("au_address", 0.35, F.when(local, address)),
        ("au_location", 0.25, F.when(~local & placed, F.concat_ws(", ", "city", "state"))),
        ("registry_number", 0.4, F.when(is_abn(F.col("abn")) | is_acn(F.col("acn")), F.lit("a valid number is stated"))),
        ("pty_ltd", 0.2, F.when(F.exists(names, lambda n: n.rlike(PTY_LTD)), F.lit("an Australian company form"))),
        ("au_phone", 0.15, F.when(F.col("phones") > 0, F.lit("an Australian phone number"))),
        ("au_source", 0.15, F.when(F.array_contains("regions", "AU"), F.lit("a source that covers Australia"))),
        ("au_mention", 0.2, _hit(said, AT_HOME)),
        ("foreign_domain", -0.25, F.when(_text("domain").rlike(FOREIGN_DOMAIN), F.col("domain"))),
        ("foreign_address", -0.35, F.when(~local, _hit(address, *FOREIGN_ADDRESS))),
        ("foreign_hq", -0.3, _hit(said, FOREIGN_SEAT)),
    ])


def startup(as_of_year: int, known: tuple[str, ...]) -> Column:
    """The signals of a subject for and against its being a startup. known: a vocabulary of investors."""
    text, name = _text("text"), _text("name")
    named = F.array_distinct(F.concat(F.coalesce("investors", F.array().cast("array<string>")), investors_in(text, F.array(*map(F.lit, known)).cast("array<string>"))))
    return _signals([
        ("funding_language", 0.35, _hit(text, FUNDING)),
        ("known_investor", 0.3, F.when(F.size(named) > 0, F.array_join(F.slice(named, 1, 3), ", "))),
        ("startup_words", 0.15, _hit(text, STARTUP_WORDS)),
        ("recent_founding", 0.1, F.when(F.col("founded_year") >= as_of_year - YOUNG_YEARS, F.col("founded_year").cast("string"))),
        ("fund_or_investor", -0.8, F.coalesce(_hit(name, FUND), _hit(text, FUND))),
        ("ordinary_business", -0.4, _hit(F.concat_ws(" ", name, text), ORDINARY)),
        ("established_company", -0.3, _hit(text, ESTABLISHED)),
        ("public_body", -0.3, _hit(name, PUBLIC_BODY)),
    ])


def signals(subjects: DataFrame, as_of_year: int, known: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, code, weight, detail) of each subject.

    subjects: id, name, aliases, domain, state, city, address, abn, acn, regions, phones, text, investors, founded_year; all
    but the id may be null.
    """
    rows = subjects.select("id", F.explode(F.array(F.struct(F.lit("australian").alias("kind"), australian().alias("s")), F.struct(F.lit("startup").alias("kind"), startup(as_of_year, known).alias("s")))).alias("k"))
    return rows.select("id", "k.kind", F.inline("k.s"))


def assess(found: DataFrame, subjects: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(id, australian, australian_score, startup, startup_score): what the signals of each subject come to.

    Evidence is only gained: signals of `earlier` looks stay, and of each code the heaviest counts. No signal at all is
    unclear, never no.
    """
    every = found.select("id", "kind", "code", "weight")
    if earlier is not None:
        every = every.unionByName(earlier.select("id", "kind", "code", "weight"))
    out = subjects.select("id")
    for kind, least in LEAST.items():
        told = sum_signals(every.where(F.col("kind") == kind), *least).select("id", F.col("verdict").alias(kind), F.col("total").alias(f"{kind}_score"))
        out = out.join(told, "id", "left").withColumns({kind: F.coalesce(kind, F.lit("unclear")), f"{kind}_score": F.coalesce(f"{kind}_score", F.lit(0.0))})
    return out


def routed(candidates: DataFrame) -> DataFrame:
    """`candidates` with goes_to: an exact match of a company is matched; a new one that is not Australian or no startup is rejected; all others wait for a person.

    candidates: resolution (NEW_COMPANY or an outcome), target_kind, australian, startup.
    """
    exact = (F.col("resolution") == "EXACT_MATCH") & (F.col("target_kind") == "company")
    gated = (F.col("resolution") == "NEW_COMPANY") & ((F.col("australian") == "no") | (F.col("startup") == "no"))
    return candidates.withColumn("goes_to", F.when(F.coalesce(exact, F.lit(False)), "matched").when(F.coalesce(gated, F.lit(False)), "rejected").otherwise("needs_review"))
