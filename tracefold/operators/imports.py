"""Bringing lists of names, people, stories and scores to the records they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entities_of(names: DataFrame, name: str, key: Column) -> DataFrame:
    """(key, name, spellings, rows): one entity for all spellings of a key, named by the commonest, then the first."""
    counts = names.where(F.col(name).isNotNull()).groupBy(key.alias("key"), name).agg(F.count(F.lit(1)).alias("n"))
    # of equally common spellings the smallest: max_by on a count and a reversed order is a window here
    w = Window.partitionBy("key").orderBy(F.desc("n"), name)
    first = counts.where("key <> ''").withColumn("__r", F.row_number().over(w))
    return first.groupBy("key").agg(F.max(F.when(F.col("__r") == 1, F.col(name))).alias("name"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"))


def match_unique(items: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(item id, record id): by a key that exactly one record has; a key that two share matches neither."""
    only = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("record_id")).where("n = 1")
    return items.join(only, key).select(F.col("id").alias("item_id"), "record_id")


def plan_people(rows: DataFrame, firms: DataFrame, people: DataFrame) -> DataFrame:
    """What an import would do with each row: link, add, or why it can't.

    rows: id, person, profile, firm_domain, firm_name. firms: id, domain, name. people: id, profile, name, firm_id. A firm is
    found by its domain, else by a name that one firm has; a person by the profile, else by name within the firm. Keys are
    normalised by the caller.
    """
    by_domain = firms.where("domain IS NOT NULL").groupBy(F.col("domain").alias("firm_domain")).agg(F.count(F.lit(1)).alias("dn"), F.min("id").alias("d_id"))
    by_name = firms.groupBy(F.col("name").alias("firm_name")).agg(F.count(F.lit(1)).alias("nn"), F.min("id").alias("n_id"))
    j = rows.join(by_domain, "firm_domain", "left").join(by_name, "firm_name", "left")
    j = j.withColumn("firm_id", F.when(F.col("dn") == 1, F.col("d_id")).when(F.col("dn").isNull() & (F.col("nn") == 1), F.col("n_id")))
    j = j.withColumn("firm_state", F.when(F.col("firm_id").isNotNull(), "found").when((F.col("dn") > 1) | (F.col("nn") > 1), "ambiguous_firm").otherwise("unknown_firm"))
    by_profile = people.where("profile IS NOT NULL").groupBy("profile").agg(F.min("id").alias("p_id"), F.min("firm_id").alias("p_firm"))
    by_both = people.groupBy(F.col("name").alias("person"), "firm_id").agg(F.min("id").alias("b_id"))
    j = j.join(by_profile, "profile", "left").join(by_both, ["person", "firm_id"], "left")
    action = (
        F.when(F.col("firm_state") != "found", F.col("firm_state"))
        .when(F.col("p_id").isNotNull() & (F.col("p_firm") != F.col("firm_id")), "other_firm")
        .when(F.col("p_id").isNotNull() | F.col("b_id").isNotNull(), "link")
        .otherwise("add")
    )
    return j.select("id", "firm_id", F.coalesce("p_id", "b_id").alias("person_id"), action.alias("action"))


def undo(rows: DataFrame, run: str) -> DataFrame:
    """A table without what one import run added."""
    return rows.where(~F.col("import_run").eqNullSafe(F.lit(run)))


def attach_funding(stories: DataFrame, matches: DataFrame, companies: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """(story_id, company_id): stories with a round, not too old, that one company alone fits, and that share an investor or
    the city with it.

    stories: id, at, round, investors, city. matches: story_id, company_id, outcome. companies: id, investors, city.
    """
    likely = matches.where(F.col("outcome").isin("LIKELY_MATCH", "EXACT_MATCH")).dropDuplicates(["story_id", "company_id"])
    alone = likely.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"), F.min("company_id").alias("company_id")).where("n = 1")
    s = stories.where(F.col("round").isNotNull() & (F.col("at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("at") <= as_of + F.make_dt_interval(F.lit(1))))
    s = s.select(F.col("id").alias("story_id"), F.col("investors").alias("s_inv"), F.col("city").alias("s_city"))
    j = s.join(alone, "story_id").join(companies.select(F.col("id").alias("company_id"), "investors", "city"), "company_id")
    backed = F.coalesce(F.arrays_overlap("s_inv", "investors"), F.lit(False)) | F.coalesce(F.col("s_city") == F.col("city"), F.lit(False))
    return j.where(backed).select("story_id", "company_id")


# Weights of confidence, and how a candidate's score is blended.
EVIDENCE_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.3}
BLEND = (0.40, 0.35, 0.25)


def score_candidates(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, score): place, kind of company and evidence, blended; capped with an open duplicate or without a website.

    candidates: id, australian, startup (sums of signals), duplicate, website. evidence: id, field, confidence.
    """
    w = F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.6).otherwise(0.3)
    per_field = evidence.groupBy("id", "field").agg(F.max(w).alias("best"))
    quality = per_field.groupBy("id").agg(F.avg("best").alias("quality"))
    j = candidates.join(quality, "id", "left")
    part = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    raw = BLEND[0] * part("australian") + BLEND[1] * part("startup") + BLEND[2] * F.coalesce("quality", F.lit(0.1))
    capped = F.when(F.col("duplicate"), F.least(raw, F.lit(0.5))).otherwise(raw)
    capped = F.when(F.coalesce(F.col("website"), F.lit("")) == "", F.least(capped, F.lit(0.6))).otherwise(capped)
    return j.select("id", F.round(capped, 2).alias("score"))


def sum_signals(signals: DataFrame, yes: float, likely: float, no: float) -> DataFrame:
    """(id, total, verdict): of each code the heaviest signal, their sum kept within -1 and 1; 'no' needs one against.

    signals: id, code, weight.
    """
    best = signals.groupBy("id", "code").agg(F.max_by("weight", F.struct(F.abs("weight").alias("a"), F.col("weight").alias("w"))).alias("weight"))
    t = best.groupBy("id").agg(F.sum("weight").alias("s"), F.min("weight").alias("low"))
    total = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s"))), 4)
    verdict = F.when(total >= yes, "yes").when(total >= likely, "likely").when((total <= no) & (F.col("low") < 0), "no").otherwise("unclear")
    return t.select("id", total.alias("total"), verdict.alias("verdict"))
