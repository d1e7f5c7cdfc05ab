"""Versions merged three ways, and a log of decisions in which an undo may itself be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.graph import greedy_first
from tracefold.shared import saved

SIDES = ("base", "ours", "theirs")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], equal=None) -> DataFrame:
    """(keys, value, state, ours, theirs): two versions of one base put together, cell by cell.

    Each table: keys (the last may be a field) and value, one row for a key; no row is no value. state: same; ours, theirs: the
    one side that changed or removed it; both: both sides changed it alike; conflict: both changed it, not alike, and the base
    stays. equal(a, b): when two stated values are one. The three tables are shuffled once, together.
    """
    equal = equal or (lambda a, b: a == b)
    side = lambda df, name: df.select(*keys, F.lit(name).alias("__side"), "value")
    rows = side(base, "base").unionByName(side(ours, "ours")).unionByName(side(theirs, "theirs"))
    pick = lambda name: F.max(F.when(F.col("__side") == name, F.col("value"))).alias(f"__{name}")
    j = rows.where("value IS NOT NULL").groupBy(*keys).agg(*[pick(s) for s in SIDES])
    b, o, t = (F.col(f"__{s}") for s in SIDES)
    alike = lambda x, y: (x.isNull() & y.isNull()) | F.coalesce(equal(x, y), F.lit(False))
    state = F.when(alike(o, b) & alike(t, b), "same").when(alike(t, b), "ours").when(alike(o, b), "theirs").when(alike(o, t), "both").otherwise("conflict")
    value = F.when(state.isin("ours", "both"), o).when(state == "theirs", t).otherwise(b)
    return j.select(*keys, value.alias("value"), state.alias("state"), o.alias("ours"), t.alias("theirs"))


def in_force(log: DataFrame) -> DataFrame:
    """The rows of a log (id, undoes, ...) that hold in the end: an undo takes the row it names away unless it is undone itself.

    undoes: the id of an earlier row, or null. An undo of a row that is not there, or not earlier, undoes nothing.
    """
    undo = log.where("undoes IS NOT NULL AND undoes < id").select(F.col("undoes").alias("late"), F.col("id").alias("early"))
    undo = undo.join(log.select(F.col("id").alias("late")), "late", "left_semi")
    return log.join(greedy_first(undo), "id", "left_anti")


SHORTEST_REASON, LONGEST_REASON = 3, 500


def settle(claims: DataFrame, stored: DataFrame, decisions: DataFrame, keys: list[str], equal_key: Column | None = None) -> DataFrame:
    """(keys, before, value, state, claims, turned_down, decision, why): each field that decisions speak of, or that is open.

    claims: keys, claim_id, value, status (only active ones speak); stored: keys, value; decisions: id, keys, kind (settle,
    dismiss, undo), winner (a claimed value, or null for the value on record), reason, undoes. equal_key: an expression of `value`
    under which equal values meet.

    A decision without a reason of 3 to 500 characters, for a value that nobody claims, to keep a value that is not there, or
    on a field whose sources agree with each other and the record, is refused, with why, and changes nothing. Of the good ones in force the latest
    settlement counts: its value goes on the record, claims of other values are turned down. Dismissed values are turned down
    as well. An undo brings back what was. state: settled, open (the sources differ, or differ from the record), agreed.
    """
    value_key = equal_key if equal_key is not None else F.lower(F.trim(F.col("value")))
    active = claims.where("status = 'active' AND value IS NOT NULL").withColumn("__k", value_key)
    per_value = saved(active.groupBy(*keys, "__k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("claim_id", "value")).alias("f")).select(*keys, "__k", "n", F.col("f.value").alias("said")), "values")
    record = stored.where("value IS NOT NULL").withColumn("__k", value_key).select(*keys, F.col("value").alias("before"), F.col("__k").alias("__before"))
    fields = per_value.groupBy(*keys).agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("values"), F.min("__k").alias("only")).join(record, keys, "full")
    disagree = (F.coalesce("values", F.lit(0)) > 1) | (F.coalesce("values", F.lit(0)) == 1) & F.col("__before").isNotNull() & (F.col("only") != F.col("__before"))
    fields = saved(fields.withColumn("open", disagree), "fields")

    held = in_force(decisions).where("kind IN ('settle', 'dismiss')").withColumn("value", F.col("winner")).withColumn("__w", value_key).drop("value")
    reason = F.length(F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), r"\s+", " ")))
    j = held.join(fields, keys, "left").join(per_value.select(*keys, F.col("__k").alias("__w"), F.col("said")), [*keys, "__w"], "left")
    keeps = F.col("winner").isNull() & (F.col("kind") == "settle")
    why = (
        F.when((reason < SHORTEST_REASON) | (reason > LONGEST_REASON), "no reason")
        .when(keeps & F.col("before").isNull(), "no value on record")
        .when(~keeps & F.col("said").isNull(), "not claimed")
        .when((F.col("kind") == "settle") & ~F.coalesce("open", F.lit(False)), "not in conflict")
    )
    judged = saved(j.select("id", *keys, "kind", F.when(keeps, F.col("__before")).otherwise(F.col("__w")).alias("__w"), F.when(keeps, F.col("before")).otherwise(F.col("said")).alias("said"), why.alias("why")), "judged")
    good = judged.where("why IS NULL")
    settled = good.where("kind = 'settle'").groupBy(*keys).agg(F.max_by(F.struct("id", "__w", "said"), "id").alias("s"))
    dismissed = good.where("kind = 'dismiss'").select(*keys, F.col("__w").alias("__k"), F.lit(True).alias("__no")).distinct()
    down = per_value.join(settled, keys, "left").join(dismissed, [*keys, "__k"], "left")
    lost = F.coalesce(F.col("s.__w") != F.col("__k"), F.lit(False)) | F.coalesce("__no", F.lit(False)) & ~F.coalesce(F.col("s.__w") == F.col("__k"), F.lit(False))
    down = down.groupBy(*keys).agg(F.sum(F.when(lost, F.col("n")).otherwise(0)).alias("turned_down"), F.sum(F.when(lost, 0).otherwise(1)).alias("left"), F.min(F.when(~lost, F.col("__k"))).alias("left_key"))
    refused = judged.where("why IS NOT NULL").groupBy(*keys).agg(F.max_by("why", "id").alias("why"))
    out = fields.join(settled, keys, "left").join(down, keys, "left").join(refused, keys, "full")
    still = (F.coalesce("left", F.lit(0)) > 1) | (F.coalesce("left", F.lit(0)) == 1) & F.col("__before").isNotNull() & (F.col("left_key") != F.col("__before"))
    state = F.when(F.col("s").isNotNull(), "settled").when(still, "open").otherwise("agreed")
    value = F.when(F.col("s").isNull() | (F.col("s.__w") == F.col("__before")), F.col("before")).otherwise(F.col("s.said"))
    return out.select(*keys, "before", value.alias("value"), state.alias("state"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("turned_down", F.lit(0)).alias("turned_down"), F.col("s.id").alias("decision"), "why")
