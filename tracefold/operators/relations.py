"""Relations between records: portfolios, related investors, and who fits whom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portfolio(links: DataFrame, owner: str, item: str) -> DataFrame:
    return links.groupBy(owner).agg(F.countDistinct(item).alias("items"))


def related(links: DataFrame, owner: str, item: str, top: int = 6) -> DataFrame:
    """(owner, other, shared, rank): the owners that share most items with each.

    An item that n owners have makes n squared pairs; the links are made distinct first, and n is the number of backers of
    one company, not of rows. The owners of an item go to each of them as one list, and pairs are only counted where all lists
    of an owner are: no row for a pair is shuffled.
    """
    d = links.select(owner, item).where(F.col(item).isNotNull() & F.col(owner).isNotNull()).distinct()
    lists = d.groupBy(item).agg(F.collect_list(owner).alias("others"))
    met = d.join(lists, item).select(owner, "others").repartition(owner)
    counts = met.select(owner, F.explode("others").alias("other")).where(F.col(owner) != F.col("other")).groupBy(owner, "other").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy(owner).orderBy(F.desc("shared"), "other")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def with_related(rows: DataFrame, key: str, related_: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """`rows` with, for each name, how many related rows there are and their labels in order: name -> (table, its key, its label).

    Each relation is grouped before it is joined; labels are those of a closed set.
    """
    for name, (other, foreign, label) in related_.items():
        per = other.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias(f"{name}_labels"))
        rows = rows.join(per, key, "left").withColumn(f"{name}_n", F.coalesce(f"{name}_n", F.lit(0)).cast("long"))
    return rows


def recent(rows: DataFrame, by: str, at: str, tie: str, top: int = 5) -> DataFrame:
    """The newest rows of each group."""
    w = Window.partitionBy(by).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranges_overlap(low: Column, high: Column, want_low: float | None, want_high: float | None) -> Column:
    """Whether two ranges meet; an open end reaches as far as it can."""
    a = F.lit(True) if want_high is None else F.coalesce(low <= want_high, F.lit(True))
    b = F.lit(True) if want_low is None else F.coalesce(high >= want_low, F.lit(True))
    return a & b


# Which wishes fit which.
FITS = {
    "cofounder": ("cofounder",),
    "build-with": ("build-with", "cofounder", "contribute"),
    "contribute": ("build-with", "cofounder"),
    "job": ("talent",),
    "talent": ("job", "contribute"),
    "meet": ("meet", "build-with", "feedback"),
    "feedback": ("feedback", "meet", "build-with"),
}
WANTS_SKILLS = ("cofounder", "build-with", "contribute", "talent")
MIN_SCORE = 4
#: People who ask at once.
ASKING = 10_000


def match_score(a: str, b: str) -> tuple[Column, Column]:
    """(score, substance) of two people with columns {a}_looking_for, {a}_skills, {a}_interests, {a}_city, {a}_remote, {a}_open_to."""
    col = lambda p, c: F.coalesce(F.col(f"{p}_{c}"), F.array().cast("array<string>"))
    fit = F.lit(0)
    for want, fits in FITS.items():
        fit = fit + F.when(F.array_contains(col(a, "looking_for"), want), F.size(F.array_intersect(col(b, "looking_for"), F.array(*map(F.lit, fits))))).otherwise(0)
    goals = F.least(fit, F.lit(2))
    wants = lambda p: F.arrays_overlap(col(p, "looking_for"), F.array(*map(F.lit, WANTS_SKILLS)))
    brings = lambda p, q: F.when(wants(p), F.least(F.size(F.array_except(col(q, "skills"), col(p, "skills"))), F.lit(2))).otherwise(0)
    skills = F.least(brings(a, b) + brings(b, a), F.lit(2))
    interests = F.least(F.size(F.array_intersect(col(a, "interests"), col(b, "interests"))), F.lit(2))
    same_city = F.coalesce(F.lower(f"{a}_city") == F.lower(f"{b}_city"), F.lit(False))
    remote = F.coalesce(F.col(f"{a}_remote") & F.col(f"{b}_remote"), F.lit(False))
    ways = F.least(F.size(F.array_intersect(col(a, "open_to"), col(b, "open_to"))), F.lit(2))
    score = 3 * goals + 2 * skills + 2 * interests + F.when(same_city, 2).when(remote, 1).otherwise(0) + ways
    return score, (goals > 0) | (skills > 0)


def recommend(me: DataFrame, people: DataFrame, met: DataFrame, top: int = 6) -> DataFrame:
    """(me_id, id, score, rank): the people who fit those of `me` best, without themselves and those they have met.

    Those who ask are sent to all tasks, ASKING of them at once; more go in blocks, a pass over the people for each.
    """
    cols = ["id", "looking_for", "skills", "interests", "city", "remote", "open_to", "created_at"]
    a = me.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = people.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    asking = a.count()
    # a block by hash has half of ASKING on average
    blocks = 1 if asking <= ASKING else -(-2 * asking // ASKING)
    part = F.pmod(F.xxhash64("a_id"), F.lit(blocks))
    # one side of proven size: every person meets the few who ask, without a shuffle
    pairs = reduce(DataFrame.unionByName, [b.join(F.broadcast(a.where(part == k)), F.col("a_id") != F.col("b_id")) for k in range(blocks)])
    score, substance = match_score("a", "b")
    scored = pairs.withColumn("score", score).where(substance & (F.col("score") >= MIN_SCORE))
    scored = scored.join(met.select(F.col("me_id").alias("a_id"), F.col("other_id").alias("b_id")), ["a_id", "b_id"], "left_anti")
    w = Window.partitionBy("a_id").orderBy(F.desc("score"), F.desc("b_created_at"), "b_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(F.col("a_id").alias("me_id"), F.col("b_id").alias("id"), "score", "rank")


def edges(parts: list[tuple[DataFrame, str, str, str, str, str]]) -> DataFrame:
    """(source_type, source_id, relation, target_type, target_id) from tables with two ids each."""
    out = None
    for rows, st, sid, relation, tt, tid in parts:
        one = rows.select(F.lit(st).alias("source_type"), F.col(sid).cast("string").alias("source_id"), F.lit(relation).alias("relation"), F.lit(tt).alias("target_type"), F.col(tid).cast("string").alias("target_id")).distinct()
        out = one if out is None else out.unionByName(one)
    return out
