"""Records in other forms: public and canonical projections, states derived from several fields, ids, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.names import slug

# Fields that are kept for record and never shown.
INTERNAL = (
    "source_ids", "confidence_score", "created_at", "updated_at", "location_source", "location_source_url",
    "location_verified_at", "location_confidence", "cover_source_url", "cover_retrieved_at", "show_on_map", "maturity_check",
)


def public(rows: DataFrame, precision: str = "location_precision", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Without internal fields; a point that stands for a whole city, state or nothing is not shown as a place."""
    vague = F.col(precision).isin("CITY", "STATE", "UNKNOWN")
    out = rows.drop(*INTERNAL)
    return out.withColumns({lat: F.when(~vague, F.col(lat)), lng: F.when(~vague, F.col(lng))})


def known(c: Column) -> Column:
    """One way to say nothing: empty and 'Unknown' become null."""
    return F.when((F.trim(c) != "") & (c != "Unknown"), c)


def lifecycle(status: Column, stage: Column) -> Column:
    """defunct, acquired or subsidiary, by the status or by how the stage begins; null for a company that goes on."""
    out = F.lit(None).cast("string")
    for name in ("subsidiary", "acquired", "defunct"):
        out = F.when((status == name) | F.coalesce(stage, F.lit("")).rlike(f"(?i)^{name}"), name).otherwise(out)
    return out


def hiring_state(hiring: Column, status: Column, confirmed_at: Column, no_roles_at: Column, as_of: Column, window_days: int | None) -> Column:
    """hiring while confirmed in the window, checked if it was, none if a page lists no roles, else unverified."""
    recent = F.lit(True) if window_days is None else F.coalesce(confirmed_at >= as_of - F.make_dt_interval(F.lit(window_days)), F.lit(False))
    return F.when(hiring & recent, "hiring").when(hiring, "checked").when((status == "not_hiring") & no_roles_at.isNotNull(), "none").otherwise("unverified")


def upcoming(dates: Column, as_of: Column, days: int = 15) -> Column:
    """The first of some dates from today on, within some days; null for none."""
    today = F.to_date(as_of)
    return F.array_min(F.filter(dates, lambda d: (d >= today) & (d < F.date_add(today, days))))


def unique_slugs(rows: DataFrame, name: str, pos: str, folded: bool = False) -> DataFrame:
    """`rows` with a slug each: the first row of a name has the plain one, others -2, -3 and so on, around those that are taken.

    A numbered slug may be another row's plain one; such rows are moved on past all numbers in use for that name.
    """
    base = F.when(slug(F.col(name), folded) != "", slug(F.col(name), folded)).otherwise("item")
    r = rows.withColumn("__base", base)
    n = F.row_number().over(Window.partitionBy("__base").orderBy(pos))
    r = r.withColumn("__n", n)
    plain = r.where("__n = 1").select(F.col("__base").alias("taken"))
    # plain slugs that look like numbered ones of another name: the numbers that this name must leave out
    parts = plain.select(F.regexp_extract("taken", r"^(.*)-(\d+)$", 1).alias("__base"), F.regexp_extract("taken", r"-(\d+)$", 1).try_cast("int").alias("k")).where("__base <> '' AND k >= 2")
    holes = parts.groupBy("__base").agg(F.array_sort(F.collect_set("k")).alias("__holes"))
    j = r.join(holes, "__base", "left")
    # the n-th number from 2 on that is no hole
    skip = F.aggregate(F.coalesce("__holes", F.array().cast("array<int>")), F.col("__n"), lambda a, h: F.when(h <= a, a + 1).otherwise(a))
    made = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", skip.cast("string")))
    return j.withColumn("slug", made).drop("__base", "__n", "__holes")


def fill_missing(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Additive migration: a stored value stays, a missing one is derived; doing it twice changes nothing."""
    return rows.withColumns({k: F.coalesce(F.col(k), c) if k in rows.columns else c for k, c in derived.items()})


def merge_claims(stored: DataFrame, found: DataFrame, keys: list[str], moving: list[str]) -> DataFrame:
    """(keys, value, confidence, action): a stored value is replaced only by more confidence, or, for fields that change in
    time, by as much; equal values keep the higher confidence; every disagreement is a conflict.

    stored and found: keys (the last is the field), value, confidence (a number).
    """
    s = stored.select(*keys, F.col("value").alias("s_value"), F.col("confidence").alias("s_conf"))
    f = found.select(*keys, F.col("value").alias("f_value"), F.col("confidence").alias("f_conf"))
    j = s.join(f, keys, "full")
    both = F.col("s_value").isNotNull() & F.col("f_value").isNotNull()
    wins = both & (F.col("s_value") != F.col("f_value")) & F.when(F.col(keys[-1]).isin(*moving), F.col("f_conf") >= F.col("s_conf")).otherwise(F.col("f_conf") > F.col("s_conf"))
    action = (
        F.when(F.col("f_value").isNull(), "kept").when(F.col("s_value").isNull(), "added").when(F.col("s_value") == F.col("f_value"), "confirmed").when(wins, "replaced").otherwise("conflict")
    )
    value = F.when(action.isin("added", "replaced"), F.col("f_value")).otherwise(F.col("s_value"))
    confidence = F.when(action == "confirmed", F.greatest("s_conf", "f_conf")).when(action.isin("added", "replaced"), F.col("f_conf")).otherwise(F.col("s_conf"))
    return j.select(*keys, value.alias("value"), confidence.alias("confidence"), action.alias("action"))


def rewrite_keys(rows: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Foreign keys after records were merged. merges: (old, new), already without chains."""
    m = merges.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def stamp_checks(state: DataFrame, checks: DataFrame) -> DataFrame:
    """Facet clocks after checks. state and checks: (id, ...); a check has at and outcome: changed, unchanged or failed.

    A change ends the streak of unchanged checks, a failure leaves it; failures count until a check succeeds.
    """
    j = state.join(checks, "id", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = F.col("outcome").isNotNull()
    good = F.col("outcome").isin("changed", "unchanged")
    return j.select(
        "id",
        (z("checks") + F.when(seen, 1).otherwise(0)).alias("checks"),
        F.when(F.col("outcome") == "unchanged", z("unchanged_streak") + 1).when(F.col("outcome") == "changed", 0).otherwise(z("unchanged_streak")).alias("unchanged_streak"),
        F.when(F.col("outcome") == "failed", z("failures") + 1).when(good, 0).otherwise(z("failures")).alias("failures"),
        F.when(F.coalesce(good, F.lit(False)), F.col("at")).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        F.when(F.col("outcome") == "changed", F.col("at")).otherwise(F.col("last_changed_at")).alias("last_changed_at"),
        F.coalesce("outcome", "last_outcome").alias("last_outcome"),
    )
