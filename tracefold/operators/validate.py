"""Rules that the tables of a directory must keep: each table's own rules in one pass, keys by anti-joins.

A rule is a condition that holds for a good row; null, as where an optional value is absent, breaks nothing. Results have the
shape of `quality.violations`: (table, id, code).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import urls as U
from tracefold.functions.addresses import STATES
from tracefold.functions.dates import DAY, PARTIAL, STAMP
from tracefold.functions.registry_numbers import is_abn, is_acn
from tracefold.operators import quality as Q
from tracefold.operators.dealing import dealt, tasks_for
from tracefold.operators.graph import circles

# What a field with a closed set may say.
COMPANY_STATUSES = ("active", "acquired", "defunct", "subsidiary")
VERIFICATION_STATUSES = ("unverified", "location_verified", "verified")
HIRING_STATUSES = ("hiring", "not_hiring")
WEBSITE_STATUSES = ("unavailable",)
EMPLOYEE_RANGES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001+")
REMOTE_POLICIES = ("remote-global", "remote-au", "hybrid", "onsite")
ORGANISATION_TYPES = ("startup", "company", "space")
MATURITIES = ("Early", "Growth", "Late-stage / mature", "Listed", "Global corp", "Community / coworking", "Collapsed", "Unverified")
SOURCE_KINDS = (
    "company_website", "company_document", "press", "investor_post", "accelerator_profile",
    "directory_listing", "aggregator", "user_supplied", "licensed_dataset", "open_dataset",
    "investor_website", "investor_document",
)
CONFIDENCES = ("high", "medium", "low")
CLAIM_STATUSES = ("active", "rejected", "superseded")

SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
CLAIM_ID = r"^[a-z0-9][a-z0-9._-]*$"
WEB = r"^https?://\S+$"
# The hosts on which a board's roles are applied for.
PROVIDER_HOSTS = {
    "greenhouse": ["greenhouse.io"], "lever": ["lever.co"], "workable": ["workable.com"], "ashby": ["ashbyhq.com"], "recruitee": ["recruitee.com"],
    "breezy": ["breezy.hr"], "pinpoint": ["pinpointhq.com"], "bamboohr": ["bamboohr.com"], "teamtailor": ["teamtailor.com"], "rippling": ["rippling.com"],
}
#: A read stamps a board and its roles within this many seconds.
SLACK = 90


def said(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def needed(c: Column) -> Column:
    """A condition that must hold even where it is null."""
    return F.coalesce(c, F.lit(False))


def distinct_names(c: Column) -> Column:
    return (F.size(c) > 0) & (F.size(F.array_distinct(c)) == F.size(c)) & F.forall(c, said)


def day_or_moment(c: Column) -> Column:
    """A day that the calendar has, or a moment."""
    return F.when(c.rlike(DAY), F.try_to_date(c).isNotNull()).otherwise(c.rlike(STAMP))


COMPANY_RULES = {
    "id": lambda c: needed(c("id").rlike(SLUG)),
    "slug": lambda c: needed(c("slug").rlike(SLUG)),
    "name": lambda c: said(c("name")),
    "hiring": lambda c: c("hiring").isNotNull(),
    "verified": lambda c: c("verified").isNotNull(),
    "half_a_point": lambda c: c("lat").isNull() == c("lng").isNull(),
    "state": lambda c: c("state").isin(*STATES),
    "state_abroad": lambda c: F.when(c("state").isNotNull(), needed(c("country") == "Australia")),
    "company_status": lambda c: c("company_status").isin(*COMPANY_STATUSES),
    "hiring_status": lambda c: c("hiring_status").isin(*HIRING_STATUSES),
    "website_status": lambda c: c("website_status").isin(*WEBSITE_STATUSES),
    "employee_range": lambda c: c("employee_range").isin(*EMPLOYEE_RANGES),
    "verification_status": lambda c: needed(c("verification_status").isin(*VERIFICATION_STATUSES)),
    "funding_total": lambda c: ~F.isnan(c("funding_total").cast("double")) & (c("funding_total") >= 0),
    "last_funding_date": lambda c: c("last_funding_date").rlike(PARTIAL),
    "confidence_score": lambda c: c("confidence_score").between(0, 1),
    "remote_policy": lambda c: c("remote_policy").isin(*REMOTE_POLICIES),
    "tech_stack": lambda c: distinct_names(c("tech_stack")),
    "team_size": lambda c: c("team_size") >= 1,
    "maturity": lambda c: c("maturity").isin(*MATURITIES),
    "organisation_type": lambda c: c("organisation_type").isin(*ORGANISATION_TYPES),
    "last_role_seen_at": lambda c: day_or_moment(c("last_role_seen_at")),
    "last_verified_at": lambda c: c("last_verified_at").rlike(STAMP),
    "created_at": lambda c: c("created_at").rlike(STAMP),
    "updated_at": lambda c: c("updated_at").rlike(STAMP),
    "hiring_disagrees": lambda c: needed(c("hiring")) == needed(c("hiring_status") == "hiring"),
    "verified_disagrees": lambda c: needed(c("verified")) == (F.coalesce(c("verification_status"), F.lit("")) != "unverified"),
    "verified_without_source": lambda c: F.when(c("last_verified_at").isNotNull(), F.coalesce(F.size(c("source_ids")), F.lit(0)) > 0),
    "founders_without_ids": lambda c: F.coalesce(F.size(c("founder_ids")), F.lit(0)) == F.coalesce(F.size(c("founders")), F.lit(0)),
}
SOURCE_RULES = {
    "id": lambda c: needed(c("id").rlike(SLUG)),
    "kind": lambda c: needed(c("kind").isin(*SOURCE_KINDS)),
    "url": lambda c: c("url").rlike(WEB),
    "retrieved_at": lambda c: c("retrieved_at").rlike(STAMP),
}
ROUND_RULES = {
    "id": lambda c: needed(c("id").rlike(SLUG)),
    "round": lambda c: said(c("round")),
    "amount": lambda c: ~F.isnan(c("amount").cast("double")) & (c("amount") >= 0),
    "currency": lambda c: F.when(c("amount").isNotNull(), needed(c("currency").rlike("^[A-Z]{3}$"))),
    "announced_on": lambda c: c("announced_on").rlike(PARTIAL),
    "lead_not_among_investors": lambda c: F.size(F.array_except(c("lead_investor_ids"), F.coalesce(c("investor_ids"), F.array().cast("array<string>")))) == 0,
}
CLAIM_RULES = {
    "id": lambda c: needed(c("id").rlike(CLAIM_ID)),
    "confidence": lambda c: needed(c("confidence").isin(*CONFIDENCES)),
    "status": lambda c: needed(c("status").isin(*CLAIM_STATUSES)),
    "verified_at": lambda c: c("verified_at").rlike(STAMP),
    "high_without_check": lambda c: F.when(c("confidence") == "high", c("verified_at").isNotNull()),
    "turned_down_without_note": lambda c: F.when(c("status").isin("rejected", "superseded"), said(c("note"))),
}


def broken(table: str, rows: DataFrame, rules: dict, id_col: str = "id") -> DataFrame:
    """The rules that rows break; a rule about a column that the table lacks is left out."""
    have = set(rows.columns)

    def condition(rule) -> Column | None:
        asked: list[str] = []
        out = rule(lambda k: asked.append(k) or F.col(k))
        return out if set(asked) <= have else None

    found = {code: c for code, r in rules.items() if (c := condition(r)) is not None}
    return Q.violations(table, rows, id_col, found)


def _listed_orphans(table: str, rows: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Rows with an id in the list `key` that no parent has, once for each row."""
    each = rows.select("id", F.explode(key).alias(key))
    return Q.orphans(table, each, "id", key, parents, "id").distinct()


def companies(rows: DataFrame, people: DataFrame, investors: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules, unique ids and slugs, and the ids that a company lists; founders' names must be those of their ids."""
    one = F.posexplode(F.arrays_zip("founder_ids", "founders"))
    named = rows.select("id", one.alias("at", "f")).select("id", F.col("f.founder_ids").alias("person"), F.col("f.founders").alias("said"))
    fold = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    p = people.select(F.col("id").alias("person"), F.col("name").alias("is"))
    wrong = named.join(p, "person").where(fold(F.col("said")) != fold(F.col("is")))
    return Q.all_violations([
        broken("companies", rows, COMPANY_RULES),
        Q.not_unique("companies", rows, ["id"]),
        Q.not_unique("companies", rows, ["slug"]),
        _listed_orphans("companies", rows, "founder_ids", people),
        _listed_orphans("companies", rows, "investor_ids", investors),
        _listed_orphans("companies", rows, "source_ids", sources),
        wrong.select(F.lit("companies").alias("table"), F.col("id").cast("string"), F.lit("founder_name").alias("code")).distinct(),
    ])


def rounds(rows: DataFrame, companies: DataFrame, investors: DataFrame, sources: DataFrame) -> DataFrame:
    return Q.all_violations([
        broken("rounds", rows, ROUND_RULES),
        Q.not_unique("rounds", rows, ["id"]),
        Q.orphans("rounds", rows, "id", "company_id", companies, "id"),
        _listed_orphans("rounds", rows, "investor_ids", investors),
        _listed_orphans("rounds", rows, "source_ids", sources),
    ])


def claims(rows: DataFrame, companies: DataFrame, sources: DataFrame, fields: tuple[str, ...], key: Column) -> DataFrame:
    """Claims against their companies and sources. `key`: a text under which equal values of a field meet.

    A source says a thing once for a field; it must be read before it is checked, and be listed by the company; a company's
    last_verified_at is no older than the newest check beneath it. Many claims are dealt over tasks by their number; those of
    one company meet in one task.
    """
    n = tasks_for(rows)
    mine = dealt(rows, n, "company_id")
    s = sources.select(F.col("id").alias("source_id"), F.col("retrieved_at").alias("__read"), F.lit(True).alias("__source"))
    c = companies.select(F.col("id").alias("company_id"), F.col("source_ids").alias("__lists"), F.col("last_verified_at").alias("__last"), F.lit(True).alias("__company"))
    j = mine.join(c, "company_id", "left").join(s, "source_id", "left")
    rules = {
        "no_source_id": F.coalesce("__source", F.lit(False)),
        "no_company_id": F.coalesce("__company", F.lit(False)),
        "field": needed(F.col("field").isin(*fields)),
        "checked_but_never_read": F.when(F.col("verified_at").isNotNull() & F.col("__source"), F.col("__read").isNotNull()),
        "source_not_listed": F.when(F.col("__source") & F.col("__company"), needed(F.array_contains("__lists", F.col("source_id")))),
    }
    once = ["company_id", "field", "source_id", "__key"]
    repeats = dealt(rows.select("id", *once[:3], key.alias("__key")), n, *once).groupBy(*once).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n > 1")
    newest = mine.groupBy("company_id").agg(F.max("verified_at").alias("newest"))
    lags = newest.join(c, "company_id").where("newest IS NOT NULL AND (__last IS NULL OR __last < newest)")
    return Q.all_violations([
        broken("claims", rows, CLAIM_RULES),
        Q.violations("claims", j, "id", rules),
        Q.not_unique("claims", rows, ["id"], n),
        repeats.select(F.lit("claims").alias("table"), F.col("id").cast("string"), F.lit("repeated").alias("code")),
        lags.select(F.lit("companies").alias("table"), F.col("company_id").cast("string").alias("id"), F.lit("older_than_its_claims").alias("code")),
    ])


def roles(rows: DataFrame, boards: DataFrame, now: datetime, same_link=U.canonical_url) -> DataFrame:
    """Open roles of a hiring desk against the last whole read of their boards.

    rows: id, source_id, provider, status, apply_url, duplicate_key, first_seen_at, last_confirmed_at, posted_at. boards:
    source_id, status, last_success_at. Roles without a board are dated by their own clock and not held against one. Where
    rows have a column `website` (the employer's), links of a provider must lead to its hosts or to the employer's own; where
    they have `au` and `remote_au` (a place in Australia, or work from it), one of them must hold. Links are held against each
    other in the form that `same_link` gives them, the canonical one if nothing else is said; roles without a duplicate key or a link are nobody's duplicate.
    """
    seconds = lambda c: F.unix_timestamp(c)
    b = boards.select("source_id", F.col("status").alias("__board"), F.col("last_success_at").alias("__read"))
    j = rows.where("status = 'open'").join(b, "source_id", "left")
    held = F.col("source_id").isNotNull() & F.col("provider").isNotNull()
    live = held & (F.coalesce("__board", F.lit("")) != "paused")
    confirmed, posted, at = seconds(F.col("last_confirmed_at")), seconds(F.col("posted_at")), seconds(F.lit(now))
    rules = {
        "board_unknown": F.when(held, F.col("__board").isNotNull()),
        "board_never_read": F.when(live & F.col("__board").isNotNull(), F.col("__read").isNotNull()),
        "should_be_hidden": F.when(live, confirmed + SLACK >= seconds(F.col("__read"))),
        "confirmed_after_read": F.when(held, confirmed <= seconds(F.col("__read")) + SLACK),
        "never_confirmed": F.when(F.col("provider").isNotNull(), F.col("last_confirmed_at").isNotNull()),
        "seen_after_confirmed": F.when(F.col("provider").isNotNull(), seconds(F.col("first_seen_at")) <= confirmed + SLACK),
        "confirmed_in_future": confirmed <= at + SLACK,
        "posted_in_future": posted <= at + 86400,
        "posted_after_confirmed": posted <= confirmed + 86400,
        "link": needed(F.col("apply_url").rlike(r"^https://\S+$")),
    }
    if "website" in rows.columns:
        own = U.host(F.col("website"))
        hosts = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in PROVIDER_HOSTS.items() for x in kv])
        allowed = F.concat(F.element_at(hosts, F.col("provider")), F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>")))
        to = U.host(F.col("apply_url"))
        rules["link_elsewhere"] = F.when(allowed.isNotNull() & to.isNotNull(), F.exists(allowed, lambda h: (to == h) | to.endswith(F.concat(F.lit("."), h))))
    if "au" in rows.columns:
        rules["not_in_australia"] = F.coalesce("au", F.lit(False)) | F.coalesce("remote_au", F.lit(False))
    again = rows.where("status = 'open' AND duplicate_key IS NOT NULL").groupBy("duplicate_key").agg(F.countDistinct("source_id").alias("n"), F.min("id").alias("id")).where("n > 1")
    link = F.coalesce(same_link(F.col("apply_url")), F.col("apply_url"))
    shared = rows.where("status = 'open' AND apply_url IS NOT NULL").groupBy(link.alias("__link")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    flag = lambda df, code: df.select(F.lit("roles").alias("table"), F.col("id").cast("string"), F.lit(code).alias("code"))
    return Q.all_violations([Q.violations("roles", j, "id", rules), Q.not_unique("roles", rows, ["id"]), flag(again, "on_two_boards"), flag(shared, "shared_link")])


# States of a relationship, states of an investor's record, classes of roles, and keys of private details.
RELATIONSHIP_STATUSES = ("verified", "unverified", "rejected")
INVESTOR_STATUSES = ("candidate", "needs_review", "verified", "published", "inactive", "rejected")
ROLE_CLASSES = ("investment", "scout", "talent", "platform", "other")
PRIVATE_KEYS = ("email", "phone", "mobile", "telephone", "whatsapp", "signal", "home_address", "address", "contact")


def investor_graph(organisations: DataFrame, people: DataFrame, memberships: DataFrame, investments: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    """The rules of the graph of investors.

    organisations: id, name, slug, parent_id, verification_status; people: id, name, slug, current_organisation_id, role_class,
    verification_status; memberships: id, person_id, organisation_id, role, source_id, note, verification_status, verified_at;
    investments: id, investor_organisation_id, company_id, round, the same of source; sources: id, retrieved_at.

    Every relationship names a page and what it says; one that is verified was read. An organisation owns nothing that owns
    it, however far up. A role stands once for a person and an organisation, an investment once for an organisation, a company
    and a round, in any case of letters. A person's record holds no private details.
    """
    named = {"id": needed(F.col("id").cast("string").rlike(CLAIM_ID)), "name": needed(F.trim("name") != ""), "slug": needed(F.col("slug").rlike(SLUG)), "status": needed(F.col("verification_status").isin(*INVESTOR_STATUSES))}
    held = [k for k in PRIVATE_KEYS if k in people.columns]
    person = named | {"role_class": F.col("role_class").isin(*ROLE_CLASSES)} | {f"private_{k}": F.col(k).isNull() for k in held}
    read = sources.select(F.col("id").alias("source_id"), F.col("retrieved_at").alias("__read"), F.lit(True).alias("__source"))
    related = {
        "no_source_id": F.coalesce("__source", F.lit(False)), "note": needed(F.trim("note") != ""), "status": needed(F.col("verification_status").isin(*RELATIONSHIP_STATUSES)),
        "verified_at": F.when(F.col("verification_status") == "verified", F.col("verified_at").isNotNull()),
        "never_read": F.when((F.col("verification_status") == "verified") & F.col("__source"), F.col("__read").isNotNull()),
    }
    once = lambda rows, key: rows.groupBy(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in key]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    flag = lambda name, df, code, id_col="id": df.select(F.lit(name).alias("table"), F.col(id_col).cast("string").alias("id"), F.lit(code).alias("code"))
    owners = organisations.where("parent_id IS NOT NULL")
    return Q.all_violations([
        Q.violations("organisations", organisations, "id", named),
        Q.violations("people", people, "id", person),
        Q.violations("memberships", memberships.join(read, "source_id", "left"), "id", related),
        Q.violations("investments", investments.join(read, "source_id", "left"), "id", related),
        *[Q.not_unique(n, df, ["id"]) for n, df in (("organisations", organisations), ("people", people), ("memberships", memberships), ("investments", investments))],
        *[Q.not_unique(f"{n}_slugs", df.where("slug IS NOT NULL"), ["slug"]) for n, df in (("organisations", organisations), ("people", people))],
        Q.orphans("organisations", organisations, "id", "parent_id", organisations, "id"),
        Q.orphans("people", people, "id", "current_organisation_id", organisations, "id"),
        Q.orphans("memberships", memberships, "id", "person_id", people, "id"),
        Q.orphans("memberships", memberships, "id", "organisation_id", organisations, "id"),
        Q.orphans("investments", investments, "id", "investor_organisation_id", organisations, "id"),
        Q.orphans("investments", investments, "id", "company_id", companies, "id"),
        flag("memberships", once(memberships, ["person_id", "organisation_id", "role"]), "repeated"),
        flag("investments", once(investments, ["investor_organisation_id", "company_id", "round"]), "repeated"),
        flag("organisations", circles(owners.select(F.col("id").alias("old"), F.col("parent_id").alias("new"))), "owns_itself", "node"),
    ])


# States of a candidate and the moves between them, outcomes, kinds and states of tasks, kinds of locations.
CANDIDATE_STEPS = {
    "candidate": ("needs_review", "matched", "rejected"),
    "needs_review": ("needs_review", "matched", "approved", "rejected", "merged"),
    "matched": ("needs_review", "merged", "rejected"),
    "approved": ("needs_review", "published", "rejected"),
    "rejected": ("needs_review",),
    "merged": (),
    "published": (),
}
RESOLUTIONS = ("NEW_COMPANY", "EXACT_MATCH", "LIKELY_MATCH", "POSSIBLE_MATCH")
TASK_STATUSES = ("queued", "running", "done", "skipped", "failed", "cancelled")
LOCATION_KINDS = ("HEADQUARTERS", "OFFICE")
PRECISIONS = ("EXACT", "SUBURB", "CITY", "STATE", "UNKNOWN")
#: How far back a clock may have stepped between two entries of a trail.
CLOCK_MINUTES = 10

CANDIDATE_RULES = {
    "id": lambda c: needed(c("id").rlike(r"^cand-[a-z0-9]+(?:-[a-z0-9]+)*$")),
    "name": lambda c: said(c("name")),
    "status": lambda c: needed(c("status").isin(*CANDIDATE_STEPS)),
    "website": lambda c: c("website").rlike(WEB),
    "state": lambda c: c("state").isin(*STATES),
    "abn": lambda c: F.when(c("abn").isNotNull(), is_abn(c("abn"))),
    "acn": lambda c: F.when(c("acn").isNotNull(), is_acn(c("acn"))),
    "resolution": lambda c: needed(c("resolution").isin(*RESOLUTIONS)),
    "no_discovery": lambda c: F.coalesce(F.size(c("discoveries")), F.lit(0)) > 0,
    "discovery": lambda c: ~F.exists(c("discoveries"), lambda x: (F.coalesce(x["source_id"], F.lit("")) == "") | (F.coalesce(x["key"], F.lit("")) == "") | ~F.coalesce(x["source_kind"].isin(*SOURCE_KINDS), F.lit(False)) | x["observed_at"].isNull()),
    "seen_before_discovered": lambda c: c("last_seen_at") >= c("first_discovered_at"),
    "published_without_company": lambda c: needed((F.coalesce(c("status"), F.lit("")) == "published") == c("published_company_id").isNotNull()),
}


def candidates(rows: DataFrame, companies_: DataFrame) -> DataFrame:
    """Candidates: their own rules, the steps of their histories, and the companies that they became.

    rows: id, name, status, website, domain, state, abn, acn, resolution, discoveries array<struct<source_id, source_kind, key, observed_at>>,
    first_discovered_at, last_seen_at, published_company_id, status_history array<struct<status, at, by>>. A history begins as
    candidate, takes allowed steps only, says when and by whom, and ends where the record stands; the domain is that of the website.
    """
    steps = F.create_map(*[x for k, v in CANDIDATE_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    h = F.col("status_history")
    n = F.coalesce(F.size(h), F.lit(0))
    before = F.slice(h, 1, F.greatest(n - 1, F.lit(0)))
    after = F.slice(h, 2, F.greatest(n - 1, F.lit(1)))
    wrong = F.exists(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p: ~F.coalesce(F.array_contains(F.try_element_at(steps, p["a"]["status"]), p["b"]["status"]), F.lit(False)))
    site = U.canonical_domain(F.col("website"))
    rules = {
        "no_history": n > 0,
        "history_begins": F.when(n > 0, needed(F.get(h, F.lit(0))["status"] == "candidate")),
        "history_step": F.when(n > 1, ~wrong),
        "history_says": F.when(n > 0, ~F.exists(h, lambda x: x["at"].isNull() | (F.coalesce(F.trim(x["by"]), F.lit("")) == ""))),
        "history_ends": F.when(n > 0, needed(F.get(h, n - 1)["status"] == F.col("status"))),
        "domain": F.col("domain").eqNullSafe(site["domain"]),
    }
    published = rows.where("published_company_id IS NOT NULL")
    return Q.all_violations([
        broken("candidates", rows, CANDIDATE_RULES), Q.violations("candidates", rows, "id", rules), Q.not_unique("candidates", rows, ["id"]),
        Q.orphans("candidates", published, "id", "published_company_id", companies_, "id"),
    ])


TASK_RULES = {
    "id": lambda c: needed(c("id").cast("string") != ""),
    "kind": lambda c: said(c("kind")),
    "status": lambda c: needed(c("status").isin(*TASK_STATUSES)),
    "attempts": lambda c: needed(c("attempts") >= 0),
    "running_without_lease": lambda c: F.when(c("status") == "running", c("lease_until").isNotNull()),
    "lease_without_running": lambda c: F.when(c("lease_until").isNotNull(), needed(c("status") == "running")),
    "finished_at": lambda c: F.when(c("status").isin("done", "skipped", "failed", "cancelled"), c("finished_at").isNotNull()),
    "finished_too_early": lambda c: F.when(c("status").isin("queued", "running"), c("finished_at").isNull()),
    "finished_before_created": lambda c: c("finished_at") >= c("created_at"),
    "waits_without_queue": lambda c: F.when(c("not_before").isNotNull(), needed(c("status") == "queued")),
}


def tasks(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Tasks of a queue: their own rules, targets that exist (kind, id), and one active task for a kind and target."""
    active = rows.where("status IN ('queued', 'running')").groupBy("kind", "target_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    lost = rows.where("target_id IS NOT NULL").join(targets.select("kind", F.col("id").alias("target_id")), ["kind", "target_id"], "left_anti")
    flag = lambda df, code: df.select(F.lit("tasks").alias("table"), F.col("id").cast("string").alias("id"), F.lit(code).alias("code"))
    return Q.all_violations([broken("tasks", rows, TASK_RULES), Q.not_unique("tasks", rows, ["id"]), flag(active, "two_active"), flag(lost, "no_target_id")])


def location_rows(rows: DataFrame, heads: DataFrame, dealt_over: int | None = None) -> DataFrame:
    """Rows of places: id, company_id, kind, precision, address, city, lat, lng. heads: the headquarters rows that companies imply.

    A company has one headquarters, which is as its own record says; an office without a place is no row; a point is whole and
    stands where the precision is one of points. dealt_over: over how many tasks both come dealt by company (none given: rows are
    counted and dealt here).
    """
    n = tasks_for(rows) if dealt_over is None else dealt_over
    mine, heads = (dealt(rows, n, "company_id"), dealt(heads, n, "company_id")) if dealt_over is None else (rows, heads)
    point = F.col("precision").isin("EXACT", "SUBURB")
    rules = {
        "kind": needed(F.col("kind").isin(*LOCATION_KINDS)), "precision": needed(F.col("precision").isin(*PRECISIONS)), "half_a_point": F.col("lat").isNull() == F.col("lng").isNull(),
        "no_point": F.when(point, F.col("lat").isNotNull()), "exact_without_address": F.when(F.col("precision") == "EXACT", said(F.col("address"))), "city_without_city": F.when(F.col("precision") == "CITY", said(F.col("city"))),
        "office_without_place": F.when(F.col("kind") == "OFFICE", needed(F.col("precision") != "UNKNOWN")),
    }
    own = heads.select("company_id", *[F.col(c).alias(f"__{c}") for c in ("precision", "address", "city", "lat", "lng")])
    hq = mine.where("kind = 'HEADQUARTERS'").join(own, "company_id")
    differs = F.lit(False)
    for c in ("precision", "address", "city", "lat", "lng"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    flag = lambda df, code: df.select(F.lit("locations").alias("table"), F.col("id").cast("string").alias("id"), F.lit(code).alias("code"))
    two = mine.where("kind = 'HEADQUARTERS'").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    return Q.all_violations([
        Q.violations("locations", rows, "id", rules), Q.not_unique("locations", rows, ["id"], n), Q.orphans("locations", rows, "id", "company_id", heads, "company_id"), flag(hq.where(differs), "differs_from_company"), flag(two, "two_headquarters"),
    ])


def audit_trail(rows: DataFrame, actions: tuple[str, ...], roles_: tuple[str, ...]) -> DataFrame:
    """Entries of a trail: pos, id, at, actor, role, action, target_type, target_id, summary. Positions put it in order; an entry much earlier than the one before is wrong."""
    rules = {
        "id": needed(F.col("id").rlike(r"^aud-\d+-\d+$")), "at": F.col("at").isNotNull(), "actor": needed((F.trim("actor") != "") & (F.length("actor") <= 80)), "role": needed(F.col("role").isin(*roles_)),
        "action": needed(F.col("action").isin(*actions)), "target": needed((F.trim("target_type") != "") & (F.trim("target_id") != "")), "summary": said(F.col("summary")),
    }
    # each entry beside the one before: a join on positions, as a window over the whole trail would be one task
    dated = rows.where("at IS NOT NULL")
    before = dated.select((F.col("pos") + 1).alias("pos"), F.col("at").alias("__before"))
    late = dated.join(before, "pos").where(F.col("at") < F.col("__before") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(CLOCK_MINUTES)))
    return Q.all_violations([Q.violations("audit_trail", rows, "id", rules), Q.not_unique("audit_trail", rows, ["id"]), late.select(F.lit("audit_trail").alias("table"), F.col("id").cast("string").alias("id"), F.lit("out_of_order").alias("code"))])
