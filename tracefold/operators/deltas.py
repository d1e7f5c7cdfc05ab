"""Results kept up to date: only the groups that a batch of changes touches are worked out anew, and a change counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.incremental import dedupe_roles, winning_order


def role_delta(state: DataFrame, changes: DataFrame, key: list[str], source: str, id_col: str, posted: str, first_seen: str) -> tuple[DataFrame, DataFrame]:
    """(state after, moved): roles with their duplicate_of after a batch of changes, as if all were ranked anew.

    state: the rows of roles with duplicate_of; changes: the same rows without it, and `op` (put or remove), one for an id.
    Only groups that hold a changed row, before or after, are ranked again; a role that was hidden behind a removed one comes
    back. moved: (id, was, now) of the rows whose duplicate_of changed.
    """
    columns = [c for c in state.columns if c != "duplicate_of"]
    no = F.lit(None).cast(state.schema["duplicate_of"].dataType)
    marked = state.join(changes.select(id_col, F.lit(True).alias("__gone")), id_col, "left").select(*columns, "duplicate_of", F.coalesce("__gone", F.lit(False)).alias("__gone"), F.coalesce("__gone", F.lit(False)).alias("__changed"))
    put = changes.where("op = 'put'").select(*columns, no.alias("duplicate_of"), F.lit(False).alias("__gone"), F.lit(True).alias("__changed"))
    rows = marked.unionByName(put)
    whole = _whole(key)
    # a group comes together once: what left it, what came and what stayed
    group = Window.partitionBy(*key)
    order = winning_order(id_col, posted, first_seen)
    best = F.min_by(F.struct(F.col(id_col).alias("wid"), F.col(source).alias("wsource")), F.when(~F.col("__gone"), order)).over(group)
    grouped = rows.where(whole).withColumns({"__w": best, "__touched": F.max("__changed").over(group)}).where("NOT __gone")
    again = F.when(F.col(source) != F.col("__w.wsource"), F.col("__w.wid"))
    grouped = grouped.select(*columns, F.when(F.col("__touched"), again).otherwise(F.col("duplicate_of")).alias("duplicate_of"))
    after = grouped.unionByName(rows.where(~whole & ~F.col("__gone")).select(*columns, no.alias("duplicate_of")))
    now = after.select(id_col, F.col("duplicate_of").alias("now"))
    moved = state.select(id_col, F.col("duplicate_of").alias("was")).join(now, id_col).where("NOT (was <=> now)").select(id_col, "was", "now")
    return after, moved


def _whole(key: list[str]) -> Column:
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return whole


def _ranked(rows: DataFrame, key: list[str], source: str, id_col: str, posted: str, first_seen: str) -> DataFrame:
    """`rows` with duplicate_of; rows with a null in their key are nobody's duplicate."""
    whole = _whole(key)
    loose = rows.where(~whole)
    ranked = dedupe_roles(rows.where(whole), key, source, id_col, posted, first_seen)
    return ranked.unionByName(loose.withColumn("duplicate_of", F.lit(None).cast(rows.schema[id_col].dataType)))


def first_ranking(rows: DataFrame, key: list[str], source: str, id_col: str, posted: str, first_seen: str) -> DataFrame:
    return _ranked(rows, key, source, id_col, posted, first_seen).select(*rows.columns, "duplicate_of")


def apply_ledger(ledger: DataFrame, applied: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger after, applied after, outcomes): entries counted once each, however often their run is handed in.

    ledger: key, entries, total, last_value, last_at; applied: (run_id, row_no) of what has been counted; entries: run_id, row_no, key, amount,
    value, at. Of entries with one (run_id, row_no) the first by key counts. outcomes: (run_id, taken, repeated). The latest
    value stands (by at, run and row), also when runs come in another order.
    """
    one = entries.groupBy("run_id", "row_no").agg(F.min(F.struct("key", "amount", "value", "at")).alias("e"), F.count(F.lit(1)).alias("copies")).select("run_id", "row_no", "e.*", "copies")
    fresh = one.join(applied, ["run_id", "row_no"], "left_anti")
    order = F.struct("at", "run_id", "row_no")
    sums = fresh.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("plus"), F.max(F.struct(order.alias("o"), F.col("value").alias("v"))).alias("last"))
    j = ledger.join(sums, "key", "full")
    newer: Column = F.col("last_at").isNull() | F.coalesce(F.col("last.o") > F.col("last_at"), F.lit(False))
    after = j.select(
        "key", (F.coalesce("entries", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("entries"), (F.coalesce("total", F.lit(0.0)) + F.coalesce("plus", F.lit(0.0))).alias("total"),
        F.when(newer & F.col("last").isNotNull(), F.col("last.v")).otherwise(F.col("last_value")).alias("last_value"),
        F.when(newer & F.col("last").isNotNull(), F.col("last.o")).otherwise(F.col("last_at")).alias("last_at"),
    )
    taken = fresh.groupBy("run_id").agg(F.count(F.lit(1)).alias("taken"))
    outcomes = entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).join(taken, "run_id", "left")
    outcomes = outcomes.select("run_id", F.coalesce("taken", F.lit(0)).alias("taken"), (F.col("rows") - F.coalesce("taken", F.lit(0))).alias("repeated"))
    return after, applied.unionByName(fresh.select("run_id", "row_no")), outcomes
