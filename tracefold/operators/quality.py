"""Audits and constraint checks: what is missing, wrong, stale or doubled in a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.dealing import dealt, tasks_for

UNKNOWN = r"(?i)^(?:unknown|n/?a|tbd|tba|none|null|undefined|-+)$"

# The tier and weight of each kind of task.
TASKS = (
    ("source_conflict", 0, 100), ("hiring_on_defunct", 0, 100), ("missing_coordinates", 0, 95), ("invalid_website", 0, 90),
    ("coordinates_outside_australia", 0, 90), ("possible_duplicate", 0, 80), ("missing_website", 1, 70), ("unconfirmed_location", 1, 65),
    ("unknown_city", 1, 60), ("unknown_sector", 1, 60), ("missing_description", 1, 50), ("unknown_stage", 1, 45), ("generic_sector", 1, 35),
    ("missing_state", 1, 30), ("stale_hiring", 2, 40), ("lifecycle_check", 2, 35), ("stale_stage", 2, 25), ("unapplied_evidence", 2, 25),
    ("weak_evidence", 2, 20), ("unverified_stage", 3, 8), ("missing_funding", 3, 12), ("missing_founders", 3, 12), ("missing_investors", 3, 10),
    ("missing_founded_year", 3, 8), ("approximate_pin", 3, 6), ("no_source", 3, 4),
)


def state_of(c: Column, kind: str = "string") -> Column:
    """present, empty, unknown, null or invalid."""
    if kind == "array":
        return F.when(c.isNull(), "null").when(F.size(c) > 0, "present").otherwise("empty")
    if kind == "number":
        d = c.cast("double")
        return F.when(c.isNull(), "null").when(F.isnan(d) | (F.abs(d) == float("inf")), "invalid").otherwise("present")
    s = F.trim(c)
    return F.when(c.isNull(), "null").when(s == "", "empty").when(s.rlike(UNKNOWN), "unknown").otherwise("present")


def attribute_states(rows: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(attribute, state, count): the attributes' states, counted in one pass. kinds: attribute -> (column, kind)."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), state_of(F.col(c), k).alias("state")) for a, (c, k) in kinds.items()])
    return rows.select(F.explode(each).alias("s")).groupBy("s.attribute", "s.state").agg(F.count(F.lit(1)).alias("count"))


def task_queue(rows: DataFrame, id_col: str, name: str, conditions: dict[str, Column], prominence: Column, weights: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(rank, id, name, tier, score, tasks): rows with something to do, the gravest first.

    A row's tier is that of its gravest task, its score the sum of all weights.
    """
    weights = weights or {code: (tier, weight) for code, tier, weight in TASKS}
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(weights[k][0]).alias("tier"), F.lit(weights[k][1]).alias("weight"), F.lit(k).alias("code"))) for k, c in conditions.items()]))
    found = rows.select(F.col(id_col).alias("id"), F.col(name).alias("name"), prominence.alias("prominence"), hits.alias("hits")).where(F.size("hits") > 0)
    scored = found.select(
        "id", "name", "prominence",
        F.array_min(F.transform("hits", lambda h: h["tier"])).alias("tier"),
        F.aggregate("hits", F.lit(0), lambda a, h: a + h["weight"]).alias("score"),
        F.array_join(F.transform(F.array_sort("hits"), lambda h: h["code"]), ",").alias("tasks"),
    )
    return scored


def rank_queue(queue: DataFrame, top: int) -> DataFrame:
    """The head of a queue with ranks from 1: only these rows meet in one task."""
    head = queue.orderBy("tier", F.desc("score"), F.desc("prominence"), "name", "id").limit(top)
    return head.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), F.desc("prominence"), "name", "id")))


def possible_duplicates(rows: DataFrame, keys: dict[str, Column], id_col: str) -> DataFrame:
    """(reason, key, rows, first_id): groups of rows that share a key."""
    each = F.array(*[F.struct(F.lit(reason).alias("reason"), k.alias("key")) for reason, k in keys.items()])
    flat = rows.select(F.col(id_col).alias("id"), F.explode(each).alias("e")).where("e.key IS NOT NULL AND e.key <> ''")
    return flat.groupBy("e.reason", "e.key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id")).where("rows > 1")


def label_variants(rows: DataFrame, column: str) -> DataFrame:
    """(key, spellings, rows): labels that differ only by case, spacing or punctuation."""
    key = F.regexp_replace(F.lower(column), "[^a-z0-9]", "")
    counts = rows.where(F.col(column).isNotNull()).groupBy(key.alias("key"), column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("key").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")).where("spellings > 1 AND key <> ''")


def violations(table: str, rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(table, id, code) for each rule that a row breaks; a rule that is null for a row is not broken."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(code)) for code, c in rules.items()]))
    return rows.select(F.lit(table).alias("table"), F.col(id_col).cast("string").alias("id"), F.explode(broken).alias("code"))


def not_unique(table: str, rows: DataFrame, key: list[str], tasks: int | None = None) -> DataFrame:
    """Keys that more than one row has. tasks: over how many tasks keys are dealt (none given: by the number of rows)."""
    keys = rows.select(*key)
    return dealt(keys, tasks_for(keys) if tasks is None else tasks, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(table).alias("table"), F.concat_ws("|", *key).alias("id"), F.lit("not_unique").alias("code"))


def orphans(table: str, rows: DataFrame, id_col: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key no parent has; a null key refers to nothing."""
    p = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.where(F.col(key).isNotNull()).join(p, key, "left_anti").select(F.lit(table).alias("table"), F.col(id_col).cast("string").alias("id"), F.lit(f"no_{key}").alias("code"))


def all_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
