"""Records merged into others: redirects closed, foreign keys of all tables rewritten, one owner for each identifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.graph import closed_redirects
from tracefold.shared import saved


@dataclass(frozen=True)
class Reference:
    """A table with foreign keys to the merged records.

    keys: its columns that hold such keys. once: columns that, with the first key and in any case of letters, may stand once
    for a record: a row that moves to a record which has such a row already is dropped. None: all rows are kept.
    """

    table: DataFrame
    id: str
    keys: tuple[str, ...]
    once: tuple[str, ...] | None = None


@dataclass
class Merged:
    records: DataFrame
    tables: dict[str, DataFrame]
    dropped: dict[str, DataFrame]
    refused: DataFrame
    redirects: DataFrame


def merge_records(records: DataFrame, id_col: str, name: str, aliases: str, merges: DataFrame, references: dict[str, Reference], closed_to: DataFrame | None = None) -> Merged:
    """`records` and all that refers to them after `merges` (old, new).

    Chains are followed to their ends. Refused, with why: a record merged into itself or round a circle (`cycle`), an end or a
    beginning that is no record (`unknown`), and an end that nothing may be merged into (`closed`: the ids in `closed_to`);
    nothing of a refused merge is rewritten. A record takes the names and aliases of all that go into it, each once in any
    case of letters, its own name aside. Every table is rewritten in one pass, has a column `moved`, and of the rows that meet
    the record's own and the smallest ids stay.
    """
    asked = saved(merges.where("old IS NOT NULL AND new IS NOT NULL").groupBy("old").agg(F.min("new").alias("new")), "merges")
    # what starts or ends at no record, or at one that takes nothing, goes first, so that a chain ends before it
    ids = records.select(F.col(id_col).alias("id"))
    open_ids = ids if closed_to is None else ids.join(closed_to.select("id"), "id", "left_anti")
    ends = asked.join(asked.select(F.col("old").alias("new")), "new", "left_anti")
    bad = asked.join(ids.withColumnRenamed("id", "old"), "old", "left_anti").select("old", "new", F.lit("unknown").alias("why"))
    bad = bad.unionByName(ends.join(ids.withColumnRenamed("id", "new"), "new", "left_anti").select("old", "new", F.lit("unknown").alias("why")))
    taken = ends.join(ids.withColumnRenamed("id", "new"), "new", "left_semi").join(open_ids.withColumnRenamed("id", "new"), "new", "left_anti")
    bad = saved(bad.unionByName(taken.select("old", "new", F.lit("closed").alias("why"))).dropDuplicates(["old"]), "refused")
    closed, endless = closed_redirects(asked.join(bad.select("old"), "old", "left_anti"))
    closed = saved(closed, "closed")
    refused = bad.unionByName(asked.join(endless, "old", "left_semi").select("old", "new", F.lit("cycle").alias("why")))

    gone = records.join(closed.select(F.col("old").alias(id_col)), id_col, "left_semi")
    given = gone.join(closed.withColumnRenamed("old", id_col), id_col).select("new", F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("a")).where("a IS NOT NULL")
    given = given.groupBy("new", F.lower("a").alias("l")).agg(F.min("a").alias("a")).groupBy("new").agg(F.array_sort(F.collect_list("a")).alias("given"))
    kept = records.join(closed.select(F.col("old").alias(id_col)), id_col, "left_anti").join(given.withColumnRenamed("new", id_col), id_col, "left")
    own = F.coalesce(aliases, F.array().cast("array<string>"))
    fresh = F.filter("given", lambda x: (F.lower(x) != F.lower(F.col(name))) & ~F.exists(own, lambda o: F.lower(o) == F.lower(x)))
    kept = kept.withColumn(aliases, F.when(F.col("given").isNotNull(), F.concat(own, fresh)).otherwise(F.col(aliases))).select(records.columns)

    out = Merged(kept, {}, {}, refused, closed)
    for label, ref in references.items():
        rows = ref.table.withColumn("moved", F.lit(False))
        for key in ref.keys:
            to = closed.select(F.col("old").alias(key), F.col("new").alias("__to"))
            rows = rows.join(to, key, "left").withColumns({"moved": F.col("moved") | F.col("__to").isNotNull(), key: F.coalesce("__to", key)}).drop("__to")
        rows = rows.select(*ref.table.columns, "moved")
        if ref.once is not None:
            fold = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
            place = F.row_number().over(Window.partitionBy(ref.keys[0], *[fold(c) for c in ref.once]).orderBy("moved", ref.id))
            rows = saved(rows.withColumn("__place", place), "rewritten")
            twin = F.col("moved") & (F.col("__place") > 1)
            out.dropped[label] = rows.where(twin).select(ref.id)
            rows = rows.where(~twin).drop("__place")
        out.tables[label] = rows
    return out


def cleared(table: DataFrame, column: str, dropped: DataFrame, dropped_id: str) -> DataFrame:
    """`table` with null for keys to rows that were dropped."""
    gone = dropped.select(F.col(dropped_id).alias(column), F.lit(True).alias("__gone"))
    return table.join(gone, column, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(table.columns)


def claim_identifiers(held: DataFrame, asked: DataFrame, compared: dict[str, str] | None = None) -> DataFrame:
    """(record, scheme, value, pos, outcome, owner): what becomes of each identifier that records ask for, in their order.

    held: (record, scheme, value); asked: the same and pos. One record owns an identifier: who has it, or else who asks first.
    recorded: it has it already, or asked before; held: it is another's, `owner`; added. `name` schemes may be many records'
    own. compared: SQL expressions of `value` under which values of a scheme are equal, in place of the value as it stands.
    """
    key = F.col("value")
    for scheme, how in (compared or {}).items():
        key = F.when(F.col("scheme") == scheme, F.expr(how)).otherwise(key)
    shared = F.col("scheme").isin("alias", "former_name", "legal_name")
    scope = F.when(shared, F.col("record").cast("string"))
    have = held.select("record", "scheme", "value", F.lit(None).cast("long").alias("pos"))
    rows = have.unionByName(asked.select("record", "scheme", "value", F.col("pos").cast("long"))).where("value IS NOT NULL AND value <> ''").withColumns({"__key": key, "__scope": scope})
    first = F.struct(F.coalesce("pos", F.lit(-1)).alias("p"), F.col("record").alias("r"))
    owners = rows.groupBy("scheme", "__key", "__scope").agg(F.min(first).alias("o"))
    mine = rows.groupBy("scheme", "__key", "record").agg(F.min(F.coalesce("pos", F.lit(-1))).alias("mine"))
    asked_rows = rows.where("pos IS NOT NULL")
    j = asked_rows.join(owners, (asked_rows["scheme"] == owners["scheme"]) & (asked_rows["__key"] == owners["__key"]) & asked_rows["__scope"].eqNullSafe(owners["__scope"])).select(asked_rows["*"], owners["o"])
    j = j.join(mine, ["scheme", "__key", "record"])
    outcome = F.when(F.col("o.r") != F.col("record"), "held").when(F.col("mine") < F.col("pos"), "recorded").otherwise("added")
    return j.select("record", "scheme", "value", "pos", outcome.alias("outcome"), F.col("o.r").alias("owner"))
