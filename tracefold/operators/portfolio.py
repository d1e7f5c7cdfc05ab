"""What of the investor side may be shown: portfolios, teams, marks on a map; and what a person should look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import geo
from tracefold.functions.names import fold
from tracefold.functions.urls import canonical_domain

PUBLIC = ("published", "inactive")
CHECKED = ("verified", "published", "inactive")
STALE_DAYS = 365

# What can be found about an investor, in order, and how much it matters.
ISSUES = (
    ("needs_review", "high"), ("new_candidate", "medium"), ("evidence_conflict", "high"), ("possible_duplicate_firm", "high"), ("compound_name", "medium"), ("stale_verification", "medium"),
    ("unsourced_claims", "medium"), ("missing_type", "low"), ("missing_location", "low"), ("missing_stages", "low"), ("missing_sectors", "low"), ("missing_website", "low"),
    ("unverified_relationships", "low"),
)
SEVERITY = {"high": 0, "medium": 1, "low": 2}
COMPOUND = r"(?i)\b(?:etc\.?|others)\b|[/()]"


def public_firms(firms: DataFrame) -> DataFrame:
    """Firms with a page of their own: published, or known to have stopped."""
    return firms.where(F.col("status").isin(*PUBLIC))


def public_people(people: DataFrame, firms: DataFrame) -> DataFrame:
    """Published people beside a public firm: without it they have no page."""
    return people.where("status = 'published'").join(public_firms(firms).select(F.col("id").alias("firm_id")), "firm_id", "left_semi")


def portfolio(investments: DataFrame, firms: DataFrame, companies: DataFrame, sources: DataFrame, funds: DataFrame, people: DataFrame) -> DataFrame:
    """(firm, company, invested_on, fund, person, url): verified investments of public firms in known companies that a source states.

    investments: firm_id, company_id, source_id, fund_id, person_id, status, invested_on. firms: id, slug, status. companies: id,
    slug. sources: id, url. funds: id, firm_id, slug, status. people: id, firm_id, slug, status. A fund or person that is not
    public is left out, the investment stays.
    """
    shown = public_firms(firms)
    fund = public_firms(funds).join(shown.select(F.col("id").alias("firm_id")), "firm_id", "left_semi").select(F.col("id").alias("fund_id"), F.col("slug").alias("fund"))
    person = public_people(people, firms).select(F.col("id").alias("person_id"), F.col("slug").alias("person"))
    rows = investments.where("status = 'verified'")
    rows = rows.join(shown.select(F.col("id").alias("firm_id"), F.col("slug").alias("firm")), "firm_id")
    rows = rows.join(companies.select(F.col("id").alias("company_id"), F.col("slug").alias("company")), "company_id")
    rows = rows.join(sources.select(F.col("id").alias("source_id"), "url"), "source_id")
    rows = rows.join(fund, "fund_id", "left").join(person, "person_id", "left")
    return rows.select("firm", "company", "invested_on", "fund", "person", "url")


def team(memberships: DataFrame, people: DataFrame, firms: DataFrame, sources: DataFrame) -> DataFrame:
    """(firm, person, role, is_current, url): verified roles of public people at public firms that a source states.

    memberships: firm_id, person_id, source_id, role, is_current, status.
    """
    rows = memberships.where("status = 'verified'")
    rows = rows.join(public_firms(firms).select(F.col("id").alias("firm_id"), F.col("slug").alias("firm")), "firm_id")
    rows = rows.join(public_people(people, firms).select(F.col("id").alias("person_id"), F.col("slug").alias("person")), "person_id")
    rows = rows.join(sources.select(F.col("id").alias("source_id"), "url"), "source_id")
    return rows.select("firm", "person", "role", F.coalesce("is_current", F.lit(False)).alias("is_current"), "url")


def with_focus(people: DataFrame, firms: DataFrame) -> DataFrame:
    """`people` with stages, sectors and focus_from: their own focus, else their firm's, and which of the two it is.

    people: firm_id, stage_focus, sector_focus; firms: id, stages, sectors.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    own = some(F.col("stage_focus")) | some(F.col("sector_focus"))
    lent = some(F.col("firm_stages")) | some(F.col("firm_sectors"))
    firm = firms.select(F.col("id").alias("firm_id"), F.col("stages").alias("firm_stages"), F.col("sectors").alias("firm_sectors"))
    out = people.join(firm, "firm_id", "left")
    return out.withColumns(
        {
            "stages": F.when(some(F.col("stage_focus")), F.col("stage_focus")).otherwise(F.col("firm_stages")),
            "sectors": F.when(some(F.col("sector_focus")), F.col("sector_focus")).otherwise(F.col("firm_sectors")),
            "focus_from": F.when(own, "person").when(lent, "firm"),
        }
    ).drop("firm_stages", "firm_sectors")


def pins(firms: DataFrame, placed: DataFrame) -> DataFrame:
    """(slug, city, state, role, precision, address, lat, lng): the marks of firms on a map.

    firms: slug, city, offices (names of cities); placed: slug, city, address, lat, lng, the office addresses that a geocoder has
    found. A listed city is marked once, as headquarters if it is that; an address in it is drawn in place of the city's centre.
    Cities that are not listed draw nothing.
    """
    spots = F.concat(
        F.array(F.struct(F.lower("city").alias("key"), F.lit(0).alias("turn"))),
        F.transform(F.coalesce("offices", F.array().cast("array<string>")), lambda o: F.struct(F.lower(o).alias("key"), F.lit(1).alias("turn"))),
    )
    named = firms.select("slug", F.inline(spots)).groupBy("slug", "key").agg(F.min("turn").alias("turn"))
    centre = geo.centres(firms.sparkSession).withColumnsRenamed({"lat": "centre_lat", "lng": "centre_lng"}).withColumn("key", F.lower("city"))
    here = placed.select("slug", F.lower("city").alias("key"), "address", "lat", "lng")
    rows = named.join(F.broadcast(centre), "key").join(here, ["slug", "key"], "left")
    exact = F.col("lat").isNotNull()
    return rows.select(
        "slug", "city", "state", F.when(F.col("turn") == 0, "headquarters").otherwise("office").alias("role"), F.when(exact, "EXACT").otherwise("CITY").alias("precision"),
        "address", F.coalesce("lat", "centre_lat").alias("lat"), F.coalesce("lng", "centre_lng").alias("lng"),
    )


def name_key(name: Column) -> Column:
    """Lower-cased words of letters and digits, without accents; '&' reads 'and'."""
    plain = F.regexp_replace(F.lower(fold(name)), "&", " and ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def possible_duplicate_firms(firms: DataFrame) -> DataFrame:
    """(id, reason, key): firms that may be one, with what they share: a name or alias, a website, or how a name begins.

    firms: id, name, aliases, website, status. A name begins as another does if the other's words, of four letters at least or
    before a compound name, stand at its start; the key is then the shorter name. Each firm meets its group by the key, so
    no two firms are compared.
    """
    live = firms.where("status <> 'rejected'").select("id", "name", "aliases", "website")
    said = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = live.select("id", F.explode(said).alias("n")).select("id", F.lit("name").alias("reason"), name_key(F.col("n")).alias("key")).where("key <> ''").distinct()
    domain = canonical_domain(F.col("website"))
    sites = live.withColumn("d", domain).where(~F.col("d")["shared"]).select("id", F.lit("website").alias("reason"), F.col("d")["domain"].alias("key"))
    shared = names.unionByName(sites)
    groups = shared.groupBy("reason", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = shared.join(groups, ["reason", "key"], "left_semi").select("id", "reason", "key")

    own = live.select("id", F.col("name").rlike(COMPOUND).alias("compound"), name_key(F.col("name")).alias("k")).where("k <> ''")
    words = F.split("k", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))
    longer = own.where(F.size(words) > 1).select("id", "compound", F.explode(starts).alias("key")).where(F.col("compound") | (F.length("key") >= 4))
    heads = own.select(F.col("k").alias("key")).distinct()
    begun = longer.join(heads, "key", "left_semi").select("id", F.lit("beginning").alias("reason"), "key")
    first = own.select("id", F.col("k").alias("key")).join(begun.select("key").distinct(), "key", "left_semi").select("id", F.lit("beginning").alias("reason"), "key")
    return equal.unionByName(begun).unionByName(first).distinct()


def review(firms: DataFrame, duplicates: DataFrame, conflicts: DataFrame, unbacked: DataFrame, gaps: DataFrame, as_of: Column) -> DataFrame:
    """(id, issues, worst): what a person should look at, worst first and then in the order of ISSUES; only firms with an issue.

    firms: id, name, status, type, city, country, stages, sectors, website, checked_at. duplicates, conflicts and unbacked hold
    ids in `id`; gaps: id, unsourced. A firm that was turned down has none.
    """
    marks = [(duplicates, "possible_duplicate_firm"), (conflicts, "evidence_conflict"), (unbacked, "unsourced_claims"), (gaps.where("unsourced > 0"), "unverified_relationships")]
    marked = reduce(DataFrame.unionByName, [t.select("id", F.lit(code).alias("code")) for t, code in marks])
    marked = marked.groupBy("id").agg(F.collect_set("code").alias("codes"))  # four codes at most
    rows = firms.where("status <> 'rejected'").join(marked, "id", "left")
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    old = F.col("checked_at").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("checked_at") > STALE_DAYS * 86400)
    holds = {
        "needs_review": F.col("status") == "needs_review", "new_candidate": F.col("status") == "candidate", "compound_name": F.col("name").rlike(COMPOUND),
        "stale_verification": F.col("status").isin(*CHECKED) & old, "missing_type": blank("type"), "missing_location": blank("city") & blank("country"),
        "missing_stages": empty("stages"), "missing_sectors": empty("sectors"), "missing_website": blank("website"),
    }
    found = [F.when(holds.get(code, F.array_contains("codes", code)), F.struct(F.lit(SEVERITY[how]).alias("rank"), F.lit(i).alias("turn"), F.lit(code).alias("code"))) for i, (code, how) in enumerate(ISSUES)]
    rows = rows.select("id", F.array_sort(F.array_compact(F.array(*found))).alias("found")).where(F.size("found") > 0)
    worst = F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("found")[0]["rank"] + 1)
    return rows.select("id", F.transform("found", lambda x: x["code"]).alias("issues"), worst.alias("worst"))
