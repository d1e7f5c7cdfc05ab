"""The whole audit of a directory: how each attribute of a company stands, and what there is to do about it.

Companies are rows of declared types, so a key that a record lacks is a null here. What other tables say of a company comes in
one table of facts, one row each (`facts`), and everything else is one pass of expressions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import addresses
from tracefold.functions.urls import host
from tracefold.operators.quality import TASKS, state_of
from tracefold.operators.records import lifecycle

# Labels that name a business model and no industry, and hosts that are nobody's own site.
GENERIC_SECTORS = (
    "saas", "b2b saas", "enterprise", "enterprise software", "software", "consumer",
    "marketplace", "hardware", "data", "analytics", "tech", "technology", "other", "general", "misc",
)
NOT_A_COMPANY_SITE = (
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "crunchbase.com",
    "wikipedia.org", "youtube.com", "github.com", "play.google.com", "apps.apple.com",
)
# How fast a stage goes out of date (others: medium), which stages are early, and how far a stage lifts a company.
VOLATILITY = {
    "Pre-seed": "high", "Seed": "high", "Early": "high", "Series A": "high",
    "Series B": "medium", "Series B+": "medium", "Growth": "medium", "Other Equity": "medium",
    "Series C": "low", "Series C+": "low", "Series D": "low", "Series D+": "low", "Series E": "low", "Unicorn": "low",
}
EARLY = ("Pre-seed", "Seed", "Early")
PROMINENCE = {
    "Unicorn": 5, "Series E": 4, "Series D+": 4, "Series D": 4, "Series C+": 4, "Series C": 4,
    "Series B+": 3, "Series B": 3, "Growth": 3, "Series A": 2, "Seed": 2, "Early": 1, "Pre-seed": 1,
}
HIRING_DAYS, STAGE_DAYS, OLD_FOR_ITS_STAGE = 30, 180, 6
SOUTH, NORTH, WEST, EAST = -45, -9, 110, 155


def website_problems(url: Column) -> Column:
    """array of what is wrong with an address as a company's own site, by its form alone."""
    s = F.trim(url)
    h = F.regexp_replace(F.lower(F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), r"^www\.", "")
    parsed = s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")
    elsewhere = F.lit(False)
    for site in NOT_A_COMPANY_SITE:
        elsewhere = elsewhere | (h == site) | h.endswith(f".{site}")
    checks = [
        ("whitespace", s.rlike(r"\s")),
        ("no_scheme", ~parsed & s.rlike(r"^[\w-]+(?:\.[\w-]+)+(?:[/?#]|$)")),
        ("not_an_address", ~parsed & ~s.rlike(r"^[\w-]+(?:\.[\w-]+)+(?:[/?#]|$)")),
        ("scheme", parsed & ~s.rlike("(?i)^https?://")),
        ("not_a_public_host", parsed & (~h.contains(".") | h.rlike(r"^\d+(?:\.\d+){3}$"))),
        ("not_its_own_site", parsed & elsewhere),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks]))


def is_generic_sector(sector: Column) -> Column:
    squash = lambda x: "".join(ch for ch in x if ch.isalnum())
    return F.regexp_replace(F.lower(sector), "[^a-z0-9]", "").isin(*[squash(x) for x in GENERIC_SECTORS])


def facts(claims: DataFrame, rounds: DataFrame, conflicts: DataFrame, unapplied: DataFrame, weak: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(id, hiring_checked, stage_checked, fields, rounds, conflicts, unapplied, weak, duplicates): one row per company named anywhere.

    claims: company_id, field, verified_at (active ones). The others have a company_id, a row for each finding. All are
    counted in one shuffle, after partial sums on the map side.
    """
    c = claims.select(
        F.col("company_id").alias("id"), F.lit("claim").alias("what"), F.col("field"),
        F.when(F.col("field") == "hiring_status", F.col("verified_at")).alias("hiring_at"),
        F.when(F.col("field").isin("stage", "last_funding_round"), F.col("verified_at")).alias("stage_at"),
    )
    parts = {"rounds": rounds, "conflicts": conflicts, "unapplied": unapplied, "weak": weak, "duplicates": duplicates}
    for what, df in parts.items():
        c = c.unionByName(df.select(F.col("company_id").alias("id"), F.lit(what).alias("what")), allowMissingColumns=True)
    counts = [F.count_if(F.col("what") == what).alias(what) for what in parts]
    return c.groupBy("id").agg(F.max("hiring_at").alias("hiring_checked"), F.max("stage_at").alias("stage_checked"), F.collect_set("field").alias("fields"), *counts)


def _of(values: dict, c: Column, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(other))


def audited(companies: DataFrame, found: DataFrame, as_of: datetime) -> DataFrame:
    """(id, name, states, tasks, tier, score, prominence): states of the attributes, and tasks, the gravest first.

    companies: id, name, website, sector, city, state, address, lat, lng, location_precision, verified, stage, company_status,
    hiring, description, founders, founded_year, funding_total, last_funding_round, last_funding_date, investors, source_ids,
    last_verified_at. A finding that a company has several times (a conflict) is as many tasks. tier is null where nothing is
    to do. A company without facts has none.
    """
    f = found.select("id", *[F.col(x).alias(f"__{x}") for x in found.columns if x != "id"])
    j = companies.join(f, "id", "left")
    n = lambda k: F.coalesce(F.col(f"__{k}"), F.lit(0))
    col, yes, now = F.col, lambda c: F.coalesce(c, F.lit(False)), F.lit(as_of)
    verified, hiring, pin = yes(col("verified")), yes(col("hiring")), col("lat").isNotNull() & col("lng").isNotNull()
    precision = col("location_precision")
    point = F.when(precision.isNull(), verified).otherwise(precision.isin("EXACT", "SUBURB"))
    unplotted = precision.isNotNull() & ~point & ~pin & yes(addresses.street(col("address")).isNotNull())
    end = lifecycle(col("company_status"), col("stage"))

    problems = F.when(state_of(col("website")) == "present", website_problems(col("website"))).otherwise(F.array().cast("array<string>"))
    at = F.when(pin & (precision.isNull() | point), F.when(col("lat").between(SOUTH, NORTH) & col("lng").between(WEST, EAST), "present").otherwise("invalid")).otherwise("null")
    year = col("founded_year").cast("double")
    real_year = (year == F.floor(year)) & year.between(1800, as_of.year)
    funded = col("funding_total").isNotNull() | col("last_funding_round").isNotNull() | col("last_funding_date").isNotNull() | (n("rounds") > 0)
    states = {
        "website": F.when(F.size(problems) > 0, "invalid").otherwise(state_of(col("website"))),
        "sector": state_of(col("sector")),
        "city": state_of(col("city")),
        "state": state_of(col("state")),
        "coordinates": at,
        "stage": state_of(col("stage")),
        "hiring": F.when(col("hiring").isNull(), "missing").otherwise("present"),
        "description": state_of(col("description")),
        "founders": state_of(col("founders"), "array"),
        "founded_year": F.when(state_of(year, "number") != "present", state_of(year, "number")).when(real_year, "present").otherwise("invalid"),
        "funding": F.when(funded, "present").otherwise("missing"),
        "investors": state_of(col("investors"), "array"),
        "source": F.when(F.coalesce(F.size("source_ids"), F.lit(0)) > 0, "present").otherwise("empty"),
        "last_verified": state_of(col("last_verified_at").cast("string")),
    }
    wide = j.select("*", F.struct(*[s.alias(k) for k, s in states.items()]).alias("__s"))
    is_ = lambda k: F.col(f"__s.{k}") == "present"

    old = lambda c, days: F.floor((F.unix_timestamp(now) - F.unix_timestamp(c)) / 86400) > days
    hiring_stale = F.coalesce(old(col("__hiring_checked"), HIRING_DAYS), F.lit(True))
    stage_old = yes(old(col("__stage_checked"), STAGE_DAYS))
    outgrown = yes(col("stage").isin(*EARLY) & (year == F.floor(year)) & (F.lit(as_of.year) - year >= OLD_FOR_ITS_STAGE))
    moves = _of(VOLATILITY, col("stage"), "medium")
    staged = end.isNull() & is_("stage") & (moves != "low")
    due = stage_old | outgrown
    once = lambda c: F.when(yes(c), 1).otherwise(0)
    times = {
        "source_conflict": n("conflicts"),
        "hiring_on_defunct": once((end == "defunct") & hiring),
        "missing_coordinates": once(verified & ~pin & (point | unplotted)),
        "invalid_website": once(F.size(problems) > 0),
        "coordinates_outside_australia": once(F.col("__s.coordinates") == "invalid"),
        "possible_duplicate": n("duplicates"),
        "missing_website": once(~F.col("__s.website").isin("present", "invalid")),
        "unconfirmed_location": once(~verified),
        "unknown_city": once(verified & ~is_("city")),
        "unknown_sector": once(~is_("sector")),
        "missing_description": once(~is_("description")),
        "unknown_stage": once(~is_("stage")),
        "generic_sector": once(is_("sector") & is_generic_sector(col("sector"))),
        "missing_state": once(verified & ~is_("state")),
        "stale_hiring": once(hiring & hiring_stale),
        "lifecycle_check": once(end.isNotNull()),
        "stale_stage": once(staged & due),
        "unapplied_evidence": n("unapplied"),
        "weak_evidence": n("weak"),
        "unverified_stage": once(staged & ~due & col("__stage_checked").isNull()),
        "missing_funding": once(~is_("funding")),
        "missing_founders": once(~is_("founders")),
        "missing_investors": once(~is_("investors")),
        "missing_founded_year": once(~is_("founded_year")),
        "approximate_pin": once(F.when(precision.isNull(), verified & pin & (state_of(col("address")) != "present")).otherwise(precision.isin("SUBURB", "CITY", "STATE"))),
        "no_source": once(~is_("source")),
    }
    weight = lambda code, w: F.when(moves == "high", float(w)).otherwise(w / 2) if code == "unverified_stage" else F.lit(float(w))
    tasks = F.filter(
        F.array(*[F.struct(F.lit(tier).alias("tier"), weight(code, w).alias("weight"), F.lit(code).alias("code"), times[code].cast("long").alias("times")) for code, tier, w in TASKS]),
        lambda t: t["times"] > 0,
    )
    gravest = F.array_sort(tasks, lambda a, b: F.when(a["tier"] != b["tier"], a["tier"] - b["tier"]).when(a["weight"] != b["weight"], F.sign(b["weight"] - a["weight"]).cast("int")).when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0))
    listed = wide.select("id", "name", F.col("__s").alias("states"), gravest.alias("tasks"), (_of(PROMINENCE, col("stage"), 0) + F.when(hiring, 1).otherwise(0)).alias("prominence"))
    return listed.select(
        "id", "name", "states", "tasks", F.try_element_at("tasks", F.lit(1))["tier"].alias("tier"),
        F.aggregate("tasks", F.lit(0.0), lambda a, t: a + t["weight"] * t["times"]).alias("score"), "prominence",
    )


def state_counts(rows: DataFrame) -> DataFrame:
    """(attribute, state, count) over `audited` rows."""
    names = rows.schema["states"].dataType.names
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(f"states.{k}").alias("state")) for k in names]))
    return rows.select(each.alias("s")).groupBy("s.attribute", "s.state").agg(F.count(F.lit(1)).alias("count"))


def task_counts(rows: DataFrame) -> DataFrame:
    """(code, tier, tasks, companies) over `audited` rows."""
    return rows.select(F.explode("tasks").alias("t")).groupBy("t.code", "t.tier").agg(F.sum("t.times").alias("tasks"), F.count(F.lit(1)).alias("companies"))


def same_site_or_name(companies: DataFrame) -> DataFrame:
    """(company_id, reason, key): a row for each group of companies of one host, or of one name, that a company is in."""
    site = F.when(state_of(F.col("website")) == "present", host(F.col("website")))
    name = F.regexp_replace(F.regexp_replace(F.lower("name"), r"\s*\([^)]*\)", ""), "[^a-z0-9]", "")
    each = F.array(F.struct(F.lit("same website domain").alias("reason"), site.alias("key")), F.struct(F.lit("same name").alias("reason"), name.alias("key")))
    flat = companies.select(F.col("id").alias("company_id"), F.explode(each).alias("e")).where("e.key <> ''").select("company_id", "e.reason", "e.key")
    shared = flat.groupBy("reason", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return flat.join(shared, ["reason", "key"])
