"""The public job board: which roles are shown, counts by place and facet, and what postings say together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.dates import age_days

#: Hours for which a role counts as confirmed, and days after which it leaves the board.
CONFIRMED_HOURS, STALE_DAYS = 48, 14
GENERIC = r"(?i)^(?:(?:general|open|spontaneous) application|expressions? of interest|join our talent|talent (?:pool|community)|future opportunit)"


def confirmation(confirmed_at: Column, as_of: Column) -> Column:
    """confirmed, recheck or stale, by when a role was last seen."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(confirmed_at)) / 3600
    return F.when(hours <= CONFIRMED_HOURS, "confirmed").when(hours <= STALE_DAYS * 24, "recheck").otherwise("stale")


def curated(roles: DataFrame, employers: DataFrame, as_of: Column) -> DataFrame:
    """Open roles of known employers with a safe link, a title of their own and a recent confirmation.

    roles: id, company_id, title, apply_url, status, last_confirmed_at. employers: id, name.
    """
    shown = roles.where((F.col("status") == "open") & F.col("apply_url").rlike(r"^https://\S+$") & ~F.col("title").rlike(GENERIC))
    shown = shown.withColumn("confirmation", confirmation(F.col("last_confirmed_at"), as_of)).where("confirmation <> 'stale'")
    return shown.join(employers.select(F.col("id").alias("company_id"), F.col("name").alias("employer")), "company_id")


def latest_first(posted: Column, first_seen: Column, confirmed: Column) -> Column:
    """The moment by which roles are ordered."""
    return F.coalesce(posted, first_seen, confirmed)


def all_words(text: Column, search: str) -> Column:
    """Whether a text holds every word of a search, in any order."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in search.lower().split()], F.lit(True))


def facet_counts(rows: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """(facet, value, count): what choosing each value would give, all other conditions kept, a facet's own left out.

    All facets are counted in one pass: a row counts for a facet if it meets every condition but that facet's.
    """
    met = {k: F.coalesce(F.col(k).isin(*v), F.lit(False)) if v else F.lit(True) for k, v in wanted.items()}
    others = lambda k: reduce(lambda a, b: a & b, [c for n, c in met.items() if n != k], F.lit(True))
    each = F.array_compact(F.array(*[F.when(others(k), F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value"))) for k in wanted]))
    return rows.select(F.explode(each).alias("f")).where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("count"))


def place_counts(roles: DataFrame, id_col: str, cities: str) -> DataFrame:
    """(place, roles): a role counts in each of its cities, once among all, and once under '' if it has none."""
    places = F.when(F.size(cities) > 0, F.array_distinct(cities)).otherwise(F.array(F.lit("")))
    per = roles.select(id_col, F.explode(F.concat(places, F.array(F.lit("*")))).alias("place"))
    return per.groupBy("place").agg(F.countDistinct(id_col).alias("roles"))


def company_index(roles: DataFrame, company: str, at: str) -> DataFrame:
    """(company, roles, newest)."""
    return roles.groupBy(company).agg(F.count(F.lit(1)).alias("roles"), F.max(at).alias("newest"))


def remote_policy(postings: DataFrame, company: str, arrangement: str) -> DataFrame:
    """(company, policy, reason): a policy only where every posting states the same one."""
    g = postings.groupBy(company).agg(F.count(F.lit(1)).alias("n"), F.count(arrangement).alias("stated"), F.countDistinct(arrangement).alias("kinds"), F.min(arrangement).alias("one"))
    ok = (F.col("n") == F.col("stated")) & (F.col("kinds") == 1)
    reason = F.when(ok, "all postings agree").when(F.col("stated") == 0, "no posting says").when(F.col("kinds") > 1, "postings differ").otherwise("some postings do not say")
    return g.select(company, F.when(ok, F.col("one")).alias("policy"), reason.alias("reason"))


def technologies(text: Column, names: dict[str, str], ambiguous: dict[str, str]) -> Column:
    """array<string> of the technologies that a text names.

    names and ambiguous: name -> pattern. An ambiguous word counts only within six characters of an unambiguous one.
    """
    plain = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)(?<![\w.-]){p}(?![\w-])"), F.lit(n)) for n, p in names.items()]))
    if not ambiguous:
        return plain
    other = "|".join(names.values())
    near = lambda p: rf"(?i)(?:(?<![\w.-])(?:{other})[^\w]{{1,6}}{p}(?![\w-])|(?<![\w.-]){p}[^\w]{{1,6}}(?:{other})(?![\w-]))"
    return F.concat(plain, F.array_compact(F.array(*[F.when(text.rlike(near(p)), F.lit(n)) for n, p in ambiguous.items()])))


def robust_bounds(points: DataFrame, by: str, lat: str, lng: str) -> DataFrame:
    """(by, lat, lng, spread): the median point of each group and the distance, in degrees, that nine tenths lie within."""
    centre = points.groupBy(by).agg(F.percentile(lat, F.lit(0.5)).alias("mlat"), F.percentile(lng, F.lit(0.5)).alias("mlng"))
    j = points.join(centre, by).withColumn("__d", F.sqrt(F.pow(F.col(lat) - F.col("mlat"), 2) + F.pow(F.col(lng) - F.col("mlng"), 2)))
    return j.groupBy(by).agg(F.first("mlat").alias("lat"), F.first("mlng").alias("lng"), F.percentile("__d", F.lit(0.9)).alias("spread"))


# Which kind of help fits which wish.
HELP_FITS = {"cofounder": ("cofounder",), "contributor": ("contribute", "build-with"), "teammate": ("job",), "advisor": ("meet",), "feedback": ("feedback",)}


def recommend_projects(me: DataFrame, projects: DataFrame, interested: DataFrame, top: int = 6, least: int = 3) -> DataFrame:
    """The projects that fit one person best, but for their own and those they have said to be interested in.

    me: one row of id, skills, looking_for, interests, city, remote. projects: id, author_id, skills_needed, collaboration,
    interests, city, remote, open, created_at. interested: project_id, member_id.
    """
    one = me.limit(1).select(*[F.col(c).alias(f"me_{c}") for c in ("id", "skills", "looking_for", "interests", "city", "remote")])
    p = projects.where("open").join(F.broadcast(one), F.col("author_id") != F.col("me_id"))
    said = interested.select(F.col("project_id").alias("id"), F.col("member_id").alias("me_id"))
    p = p.join(said, ["id", "me_id"], "left_anti")
    shared = lambda a, b: F.least(F.size(F.array_intersect(a, b)), F.lit(2))
    helps = reduce(lambda a, b: a | b, [F.array_contains("collaboration", k) & F.arrays_overlap("me_looking_for", F.array(*map(F.lit, v))) for k, v in HELP_FITS.items()])
    skills, helped = shared("me_skills", "skills_needed"), F.coalesce(helps, F.lit(False))
    near = F.when(F.lower("me_city") == F.lower("city"), 2).when(F.col("me_remote") & F.col("remote"), 1).otherwise(0)
    score = 3 * skills + F.when(helped, 3).otherwise(0) + 2 * shared("me_interests", "interests") + near
    found = p.withColumn("score", score).where(((skills > 0) | helped) & (F.col("score") >= least))
    return found.orderBy(F.desc("score"), F.desc("created_at"), "id").limit(top).select("id", "score")


def stale_board(roles: DataFrame, as_of: Column) -> DataFrame:
    """(age, roles): how many days ago roles were last confirmed, as a histogram of at most thirty days and more."""
    return roles.groupBy(F.least(age_days(F.col("last_confirmed_at"), as_of), F.lit(30)).alias("age")).agg(F.count(F.lit(1)).alias("roles"))
