"""The investor side of a directory, and what both sides show: cards, markers, selection, facets, orders, gaps."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.names import fold
from tracefold.operators.relations import ranges_overlap

# The fields of a company's card and of its marker on a map, in order.
CARD_FIELDS = (
    "name", "slug", "sector", "sectorGroup", "sectorFull", "city", "stage", "hiring", "hiringState", "hiring_checked_at", "rolesUnverified", "hiring_source_url", "website_status",
    "verified", "website", "blurb", "taskGate", "last_verified_at", "events", "team_size", "remote_policy", "tech_stack", "last_funding_date", "last_role_seen_at", "cohorts",
    "programs", "organisation_type", "cover", "maturity",
)
MARKER_FIELDS = ("slug", "name", "lat", "lng", "sector", "city", "hiring", "domain", "precision", "place", "checked", "logo", "metro", "sectorGroup", "suburb")


def card(rows: DataFrame, named: str = "card") -> DataFrame:
    """`rows` with the card as JSON: the card's fields that the table has, in their order, without those that are null."""
    here = [c for c in CARD_FIELDS if c in rows.columns]
    return rows.withColumn(named, F.to_json(F.struct(*here)))


def markers(rows: DataFrame) -> DataFrame:
    """The marker fields of the rows that are drawn: verified, with a point that is known as an address or a suburb."""
    drawn = F.col("verified") & F.col("precision").isin("EXACT", "SUBURB") & ~F.isnan("lat") & ~F.isnan("lng") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return rows.where(drawn).select(*[flag(c) if c in ("hiring", "checked") else F.coalesce(c, F.lit("")).alias(c) if c == "place" else F.col(c) for c in MARKER_FIELDS])


@dataclass(frozen=True)
class Wanted:
    """What is asked of investors; empty: no condition. kind: firm, person or all. The values of one condition are alternatives."""

    search: str = ""
    kind: str = "firm"
    scope: str | None = None
    slugs: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    lead: tuple[str, ...] = ()
    active: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    cheque_min: float | None = None
    cheque_max: float | None = None


def _name_key(name: str) -> str:
    """A name that is asked for, without accents, case and spacing."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(plain.lower().split())


def wanted(w: Wanted) -> Column:
    """One condition over the columns search, kind, scope, slug, name, aliases, type, stages, sectors, places, lead_or_follow,
    active_status, status, role_class, cheque_low, cheque_high and cheque_currency.

    Conditions on leading, activity, cheques and names describe a firm: no person meets them.
    """
    parts = [] if w.kind == "all" else [F.col("kind") == w.kind]
    one_of = lambda column, values: F.arrays_overlap(column, F.array(*map(F.lit, values)))
    if w.search:
        parts.append(F.contains(F.lower("search"), F.lit(w.search.lower().replace("\n", " "))))
    if w.scope == "au":
        parts.append(F.col("scope") == "au")
    if w.slugs:
        parts.append(F.col("slug").isin(*w.slugs))
    if w.names:
        # all names of an entry are folded at once
        said = F.array_join(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), "\n")
        keys = F.transform(F.split(F.lower(fold(said)), "\n"), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
        parts.append(F.arrays_overlap(keys, F.array(*[F.lit(_name_key(n)) for n in w.names])))
    if w.types:
        parts.append(F.col("type").isin(*w.types))
    if w.stages:
        parts.append(one_of(F.col("stages"), w.stages))
    if w.sectors:
        parts.append(one_of(F.transform("sectors", F.lower), [s.lower() for s in w.sectors]))
    if w.places:
        parts.append(one_of(F.col("places"), w.places))
    if w.lead:
        both = (F.col("lead_or_follow") == "both") & F.lit(bool({"lead", "follow"} & set(w.lead)))
        parts.append(F.col("lead_or_follow").isin(*w.lead) | both)
    if w.active:
        parts.append(F.col("active_status").isin(*w.active) | ((F.col("status") == "inactive") & F.lit("inactive" in w.active)))
    if w.roles:
        parts += [F.col("kind") == "person", F.col("role_class").isin(*w.roles)]
    if w.cheque_min is not None or w.cheque_max is not None:
        parts.append((F.col("cheque_currency") == "AUD") & ranges_overlap(F.col("cheque_low"), F.col("cheque_high"), w.cheque_min, w.cheque_max))
    if w.lead or w.active or w.names or w.cheque_min is not None or w.cheque_max is not None:
        parts.append(F.col("kind") == "firm")
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def facets(entries: DataFrame, stage_order: tuple[str, ...] = ()) -> DataFrame:
    """(facet, value, count, rank): how many entries have each value, in one pass; most first, stages in their own order."""
    firm = F.col("kind") == "firm"
    whole = lambda c: F.array(c)
    active = F.when(firm, F.when(F.col("status") == "inactive", "inactive").otherwise(F.col("active_status")))
    role = F.when(~firm, F.col("role_class"))
    values = {
        "type": whole(F.col("type")), "stage": F.col("stages"), "sector": F.col("sectors"), "location": F.col("places"), "lead": whole(F.when(firm, F.col("lead_or_follow"))),
        "active": whole(active), "role": whole(role), "scope": whole(F.col("scope")), "kind": whole(F.col("kind")),
    }
    pairs = F.concat(*[_pairs(name, v) for name, v in values.items()])
    counts = entries.select(F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    place = F.when(F.col("facet") == "stage", F.array_position(F.array(*map(F.lit, stage_order or ("",))), F.col("value"))).otherwise(0)
    w = Window.partitionBy("facet").orderBy(place, F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w))


def _pairs(name: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("facet"), x.alias("value")))


def ordered_page(entries: DataFrame, sort: str = "name", offset: int = 0, size: int = 48) -> DataFrame:
    """A page of entries in one of the orders, with its place; entries without a location come last in that order."""
    name, tie = F.lower("name"), F.col("slug")
    orders = {
        "name": [name.asc(), tie.asc()], "name_desc": [name.desc(), tie.asc()], "portfolio": [F.desc("portfolio_count"), name.asc(), tie.asc()],
        "location": [F.lower("location").asc_nulls_last(), name.asc(), tie.asc()],
    }
    page = entries.orderBy(*orders[sort]).offset(offset).limit(size)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*orders[sort])) + offset)  # a page, in one task


def relationship_gaps(companies: DataFrame, investors: DataFrame, investments: DataFrame) -> DataFrame:
    """(investor_id, links, unsourced): of the companies that name an investor, how many no investment row backs.

    companies: (company_id, investor_ids); investors: (investor_id, status); investments: (company_id, investor_id, status).
    Rejected investors and investments do not count.
    """
    known = investors.where("status <> 'rejected'").select("investor_id")
    named = companies.select("company_id", F.explode("investor_ids").alias("investor_id")).join(known, "investor_id", "left_semi")
    backed = investments.where("status <> 'rejected'").select("company_id", "investor_id").distinct().withColumn("backed", F.lit(1))
    per = named.join(backed, ["company_id", "investor_id"], "left").groupBy("investor_id")
    return per.agg(F.count(F.lit(1)).alias("links"), F.sum(F.when(F.col("backed").isNull(), 1).otherwise(0)).cast("long").alias("unsourced"))


def claims_without_records(subjects: DataFrame, records: DataFrame, single: tuple[str, ...], multi: tuple[str, ...], key) -> DataFrame:
    """(subject_id, field, value): what a record states that no active record of a page backs; of a list, each member.

    `key` gives the text under which equal values meet. Null and empty fields state nothing.
    """
    struct = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    stated = [F.array(struct(f, F.col(f).cast("string"))) for f in single]
    for f in multi:
        stated.append(F.transform(F.coalesce(f, F.array().cast("array<string>")), _stated(f)))
    rows = subjects.select("subject_id", F.inline(F.concat(*stated))).where(F.col("value").isNotNull() & (F.col("value") != ""))
    rows = rows.withColumn("key", key(F.col("value")))
    backed = records.where("status = 'active'").select("subject_id", "field", key(F.col("value")).alias("key")).distinct()
    return rows.join(backed, ["subject_id", "field", "key"], "left_anti").drop("key")


def _stated(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))
