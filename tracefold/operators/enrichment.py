"""What a read of a company's site changes: claims that are new, seen again or turned down before, and fields that they fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.dealing import dealt, tasks_for
from tracefold.operators.evidence import label, rank

KEYS = ["company_id", "field", "key"]


def take_claims(held: DataFrame, found: DataFrame) -> DataFrame:
    """(company_id, field, key, source_id, value, confidence, verified_at, outcome): what becomes of each claim of a read.

    held: company_id, field, key, source_id, status, verified_at; found: company_id, field, key, source_id, value, confidence, verified_at; `key` is a
    text under which equal values meet. held: such a value was turned down before, by whatever source, and is not added
    again. refreshed: the same page says it again, and the later check stands. added: the rest. A claim that is found twice
    on one page is one.
    """
    one = found.groupBy(*KEYS, "source_id").agg(F.max_by("value", F.struct(rank(F.col("confidence")), "value")).alias("value"), F.max(rank(F.col("confidence"))).alias("__r"), F.max("verified_at").alias("verified_at"))
    down = held.where("status <> 'active'").select(*KEYS).distinct().withColumn("__down", F.lit(True))
    same = held.groupBy(*KEYS, "source_id").agg(F.max("verified_at").alias("__checked"), F.lit(True).alias("__has"))
    j = one.join(down, KEYS, "left").join(same, [*KEYS, "source_id"], "left")
    outcome = F.when(F.col("__down"), "held").when(F.col("__has"), "refreshed").otherwise("added")
    return j.select(*KEYS, "source_id", "value", label(F.col("__r")).alias("confidence"), F.greatest("verified_at", "__checked").alias("verified_at"), outcome.alias("outcome"))


def fill_fields(active: DataFrame, touched: DataFrame, stored: DataFrame, fillable: tuple[str, ...], fill: bool) -> DataFrame:
    """(company_id, field, action, value, best): what the active claims of each touched field mean for the record.

    active: company_id, field, key, value, confidence, pos (the order of claims); touched: (company_id, field); stored: company_id,
    field, stored_key (null: unknown), once for a field. conflict: the claims differ. confirmed: they say what the record says.
    differs: they agree, and the record says something else, which is never overwritten. fill: the record says nothing, the
    field may be filled, filling is on and a claim is of high confidence; suggest: the same without one of these.
    """
    # claims, touched fields and the record meet in one grouping: they are dealt once and sorted once
    of = ["company_id", "field"]
    claims = active.select(*of, "key", "value", "pos", rank(F.col("confidence")).alias("best"), F.lit(True).alias("claim"))
    met = claims.unionByName(touched.select(*of, F.lit(True).alias("touched")), True).unionByName(stored.select(*of, "stored_key"), True)
    # keys differ where the least is not the greatest: to count them, claims would be sorted again
    most = [F.max(c).alias(c) for c in ("best", "stored_key", "claim", "touched")]
    per = dealt(met, tasks_for(met), *of).groupBy(*of).agg(F.min("key").alias("key"), F.max("key").alias("last"), F.min_by("value", "pos").alias("value"), *most)
    j = per.where("claim AND touched AND company_id IS NOT NULL AND field IS NOT NULL")
    may = F.col("field").isin(*fillable) & F.lit(fill) & (F.col("best") == 3)
    action = (
        F.when(F.col("last") != F.col("key"), "conflict").when(F.col("stored_key") == F.col("key"), "confirmed").when(F.col("stored_key").isNotNull(), "differs").when(may, "fill").otherwise("suggest")
    )
    return j.select("company_id", "field", action.alias("action"), F.when(action != "conflict", F.col("value")).alias("value"), label(F.col("best")).alias("best"))
