"""Job boards: answers of different providers as one table of postings, and where postings are.

Each provider is a set of paths into its answer; adding one adds no code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.urls import canonical_url


@dataclass(frozen=True)
class Provider:
    """Paths of a provider's answer; total: where the answer says how many postings it has."""

    records: str
    external_id: str
    title: str
    url: str
    location: str
    team: str | None = None
    workplace: str | None = None
    employment: str | None = None
    posted_at: str | None = None
    total: str | None = None


# Public shapes of the answers of job boards.
PROVIDERS = {
    "greenhouse": Provider("$.jobs", "$.id", "$.title", "$.absolute_url", "$.location.name", "$.departments[0].name", posted_at="$.first_published", total="$.meta.total"),
    "lever": Provider("$", "$.id", "$.text", "$.hostedUrl", "$.categories.location", "$.categories.team", "$.workplaceType", "$.categories.commitment"),
    "ashby": Provider("$.jobs", "$.id", "$.title", "$.jobUrl", "$.location", "$.department", "$.workplaceType", "$.employmentType", "$.publishedAt"),
    "workable": Provider("$.jobs", "$.shortcode", "$.title", "$.url", "$.location.location_str", "$.department", "$.workplace", "$.employment_type", "$.published_on"),
    "recruitee": Provider("$.offers", "$.id", "$.title", "$.careers_url", "$.location", "$.department", None, "$.employment_type_code", "$.published_at"),
    "breezy": Provider("$", "$.id", "$.name", "$.url", "$.location.name", "$.department", None, "$.type.id", "$.published_date"),
    "pinpoint": Provider("$.data", "$.id", "$.title", "$.url", "$.location.name", "$.job.department.name", "$.workplace_type", "$.employment_type"),
    "bamboohr": Provider("$.result", "$.id", "$.jobOpeningName", "$.url", "$.location.city", "$.departmentLabel", None, "$.employmentStatusLabel", total="$.meta.totalCount"),
    "teamtailor": Provider("$.jobs", "$.id", "$.title", "$.careersite_job_url", "$.location", "$.department", "$.remote_status", None, "$.created_at"),
    "rippling": Provider("$", "$.uuid", "$.name", "$.url", "$.workLocation.label", "$.department.label"),
}


def postings(answers: DataFrame, body: str = "body", provider: str = "provider", source: str = "source_id") -> DataFrame:
    """(source_id, provider, external_id, title, url, canonical_url, location, team, workplace, employment, posted_at)."""
    parts = None
    for name, p in PROVIDERS.items():
        get = lambda path: F.try_variant_get("r", path, "string") if path else F.lit(None).cast("string")
        mine = answers.where(F.col(provider) == name).select(source, F.col(provider).alias("provider"), F.explode(F.try_variant_get(F.try_parse_json(body), p.records, "array<variant>")).alias("r"))
        one = mine.select(
            F.col(source).alias("source_id"), "provider", get(p.external_id).alias("external_id"), F.trim(get(p.title)).alias("title"), get(p.url).alias("url"),
            canonical_url(get(p.url)).alias("canonical_url"), get(p.location).alias("location"), get(p.team).alias("team"), get(p.workplace).alias("workplace"),
            get(p.employment).alias("employment"), get(p.posted_at).alias("posted_at"),
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts.where("external_id IS NOT NULL AND title <> ''")


def incomplete(answers: DataFrame, body: str = "body", provider: str = "provider", source: str = "source_id") -> DataFrame:
    """Answers that are no complete read: they do not parse, have no list, or have fewer postings than they say."""
    v = F.try_parse_json(body)
    size, total = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, p in PROVIDERS.items():
        size = F.when(F.col(provider) == name, F.size(F.try_variant_get(v, p.records, "array<variant>"))).otherwise(size)
        if p.total:
            total = F.when(F.col(provider) == name, F.try_variant_get(v, p.total, "int")).otherwise(total)
    return answers.where(size.isNull() | (size < 0) | (total.isNotNull() & (total != size))).select(source, provider)


def boards_in(html: Column) -> Column:
    """array<string> of the boards that a page links to, as provider/token."""
    hosts = (
        ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([A-Za-z0-9_-]+)"),
        ("lever", r"jobs\.lever\.co/([A-Za-z0-9_-]+)"),
        ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)"),
        ("workable", r"apply\.workable\.com/([A-Za-z0-9_-]+)"),
        ("recruitee", r"([A-Za-z0-9-]+)\.recruitee\.com"),
        ("breezy", r"([A-Za-z0-9-]+)\.breezy\.hr"),
        ("bamboohr", r"([A-Za-z0-9-]+)\.bamboohr\.com"),
        ("teamtailor", r"([A-Za-z0-9-]+)\.teamtailor\.com"),
        ("rippling", r"ats\.rippling\.com/([A-Za-z0-9_-]+)"),
    )
    found = [F.regexp_extract_all(html, F.lit(p), F.lit(1)) for _, p in hosts]
    return F.array_distinct(F.concat(*[F.transform(f, _prefixed(n)) for (n, _), f in zip(hosts, found, strict=True)]))


def _prefixed(name: str):
    return lambda t: F.concat(F.lit(f"{name}/"), F.lower(t))


def employment(text: Column) -> Column:
    """full_time, part_time, contract, internship or fixed_term, null for none."""
    s = F.lower(text)
    return (
        F.when(s.rlike(r"\bintern(?:ship)?s?\b"), "internship")
        .when(s.rlike(r"fixed[\s_-]?term"), "fixed_term")
        .when(s.rlike(r"part[\s_-]?time"), "part_time")
        .when(s.rlike(r"\bcontract(?:or)?\b|\btemporary\b|\bcasual\b"), "contract")
        .when(s.rlike(r"full[\s_-]?time|\bpermanent\b"), "full_time")
    )


def level(title: Column) -> Column:
    """The seniority that a title states; mid where it states none."""
    s = F.lower(title)
    return (
        F.when(s.rlike(r"\bintern(?:ship)?\b"), "intern")
        .when(s.rlike(r"\bgrad(?:uate)?\b"), "graduate")
        .when(s.rlike(r"\bjunior\b|\bjr\b"), "junior")
        .when(s.rlike(r"\bhead\b|\bdirector\b|\bvp\b|\bchief\b|\bc[teof]o\b"), "head")
        .when(s.rlike(r"\blead\b|\bprincipal\b|\bstaff\b"), "lead")
        .when(s.rlike(r"\bsenior\b|\bsr\b"), "senior")
        .otherwise("mid")
    )


def arrangement(workplace: Column, labels: Column) -> Column:
    """remote, hybrid or on_site: what the provider's field says, else what the place says."""
    t, place = F.regexp_replace(F.lower(F.trim(workplace)), r"[_\s]+", "-"), F.lower(labels)
    return (
        F.when(t == "remote", "remote")
        .when(t == "hybrid", "hybrid")
        .when(t.isin("on-site", "onsite"), "on_site")
        .when(place.rlike(r"\bhybrid\b"), "hybrid")
        .when(place.rlike(r"\bremote\b"), "remote")
    )
