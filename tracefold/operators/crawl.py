"""Which pages of a site to read: the fewest that answer what is wanted, chosen greedily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.shared import saved

# Kinds of pages by their path or the words of a link, and the fields that each tends to answer, in this order.
KINDS = (
    ("privacy", "privacy", ("address", "city", "state")),
    ("terms", "terms|legal", ("address", "city", "state")),
    ("contact", "contact", ("address", "city", "state")),
    ("about", "about|company|team|our-story", ("founders", "founded_year", "investors", "description")),
    ("careers", "careers?|jobs|join-?us|work-?with-?us|vacanc|we.?re-?hiring", ("hiring_status", "jobs")),
)
FILE = r"(?i)\.(?:pdf|png|jpe?g|gif|svg|zip|docx?)$"


def kind_of(path: Column, words: Column) -> Column:
    """The first kind that a path or the words of a link name; null for none, and for files."""
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(KINDS):
        out = F.when(F.coalesce(path, F.lit("")).rlike(f"(?i){pattern}") | F.coalesce(words, F.lit("")).rlike(f"(?i){pattern}"), name).otherwise(out)
    return F.when(~F.coalesce(path, F.lit("")).rlike(FILE), out)


def serves(kind: Column) -> Column:
    """array<string>: the fields that a kind of page tends to answer."""
    m = F.create_map(*[x for name, _, fields in KINDS for x in (F.lit(name), F.array(*map(F.lit, fields)))])
    return F.coalesce(F.try_element_at(m, kind), F.array().cast("array<string>"))


def plan(pages: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """(site, page, turn, covers): up to `limit` pages of each site, each turn the one that answers most of what is still wanted.

    pages: site, page, pos, serves array<string>; wanted: site, fields array<string>. The first by `pos` among equals; a page
    that answers nothing new is not read. One turn is one pass over the pages that still could help, so there are `limit` at
    most; a site of any number of pages sends one row for each task and turn.
    """
    left = saved(wanted.where(F.size("fields") > 0).select("site", F.array_distinct("fields").alias("left")), "wanted")
    useful = pages.where("page IS NOT NULL")
    chosen = None
    for turn in range(1, limit + 1):
        gain = F.size(F.array_intersect("serves", "left"))
        best = useful.join(left, "site").withColumn("gain", gain).where("gain > 0").groupBy("site").agg(F.min_by(F.struct("page", "pos", "serves"), F.struct((-F.col("gain")).alias("g"), "pos", "page")).alias("b"))
        step = saved(best.join(left, "site").select("site", F.col("b.page").alias("page"), F.lit(turn).alias("turn"), F.array_sort(F.array_intersect("left", "b.serves")).alias("covers"), F.array_except("left", "b.serves").alias("left")), "turns")
        if step.isEmpty():
            break
        chosen = step.drop("left") if chosen is None else chosen.unionByName(step.drop("left"))
        left = step.where(F.size("left") > 0).select("site", "left")
    return chosen if chosen is not None else wanted.sparkSession.createDataFrame([], "site string, page string, turn int, covers array<string>")
