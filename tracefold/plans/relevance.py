"""Verdicts on candidates, and what reads of sites change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import enrichment, relevance
from tracefold.plans.base import query
from tracefold.session import table

KINDS = ("Acme raises $5m in seed round, a Sydney-based software startup", "Plumbing since 1980 all over Australia", "backed by Blackbird, founder of a platform", "nothing to say", "London-based maker of an app", "Maiden fund of two partners")


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS t, c_custkey % 4 AS d, c_custkey % 5 AS a, c_custkey % 7 AS y FROM customer),
s AS (
  SELECT id,
    [CASE WHEN d = 0 THEN 0.35 END, CASE WHEN a = 0 THEN 0.35 END, CASE WHEN a = 1 THEN 0.25 END, CASE WHEN y = 1 THEN 0.4 END, CASE WHEN d = 3 THEN 0.2 END, CASE WHEN t IN (0, 1) THEN 0.2 END,
     CASE WHEN d = 1 THEN -0.25 END, CASE WHEN a = 2 THEN -0.35 END, CASE WHEN t = 4 THEN -0.3 END] AS au,
    [CASE WHEN t IN (0, 2) THEN 0.35 END, CASE WHEN t = 2 OR y = 2 THEN 0.3 END, CASE WHEN t IN (0, 2, 4) THEN 0.15 END, CASE WHEN y = 3 THEN 0.1 END, CASE WHEN t = 5 OR d = 2 THEN -0.8 END, CASE WHEN t = 1 THEN -0.4 END, CASE WHEN t = 1 THEN -0.3 END] AS st
  FROM c),
v AS (
  SELECT id, round(greatest(-1, least(1, coalesce(list_sum(au), 0))), 4)::DOUBLE AS a, coalesce(list_min(au), 0) < 0 AS al, round(greatest(-1, least(1, coalesce(list_sum(st), 0))), 4)::DOUBLE AS s, coalesce(list_min(st), 0) < 0 AS sl FROM s),
w AS (
  SELECT id, a AS australian_score, s AS startup_score, CASE WHEN a >= 0.6 THEN 'yes' WHEN a >= 0.3 THEN 'likely' WHEN a <= -0.2 AND al THEN 'no' ELSE 'unclear' END AS australian,
    CASE WHEN s >= 0.5 THEN 'yes' WHEN s >= 0.2 THEN 'likely' WHEN s <= -0.2 AND sl THEN 'no' ELSE 'unclear' END AS startup FROM v)
SELECT id, australian, australian_score, startup, startup_score, CASE WHEN id % 9 = 0 THEN 'matched' WHEN id % 9 <> 1 AND (australian = 'no' OR startup = 'no') THEN 'rejected' ELSE 'needs_review' END AS goes_to FROM w
""")
def relevance_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as candidates, by what is said of them."""
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    subjects = table(spark, d, "customer").select(
        k.alias("id"), pick("Acme", "Beta", "Gamma Ventures", "Delta").alias("name"), F.when(k % 4 == 3, F.array(F.lit("Delta Pty. Ltd"))).alias("aliases"), pick("acme.com.au", "beta.co.uk", "gamma.com", None).alias("domain"),
        F.when(k % 5 == 1, "WA").alias("state"), F.when(k % 5 == 1, "Perth").when(k % 5 == 3, "Unknown").alias("city"), pick("1 High St, Perth WA 6000", None, "1 Main St, Austin TX 78701", "", "somewhere").alias("address"),
        F.when(k % 7 == 1, "51824753556").otherwise("51824753557").alias("abn"), F.lit(None).cast("string").alias("acn"), F.array().cast("array<string>").alias("regions"), F.lit(0).alias("phones"), pick(*KINDS).alias("text"),
        F.when(k % 7 == 2, F.array(F.lit("Somebody"))).alias("investors"), F.when(k % 7 == 3, 2015).when(k % 7 == 4, 1990).alias("founded_year"),
    )
    told = relevance.assess(relevance.signals(subjects, 2024, ("Blackbird", "Air")), subjects)
    resolution = F.when(F.col("id") % 9 == 0, "EXACT_MATCH").when(F.col("id") % 9 == 1, "POSSIBLE_MATCH").otherwise("NEW_COMPANY")
    return relevance.routed(told.withColumns({"resolution": resolution, "target_kind": F.lit("company")})).select("id", "australian", "australian_score", "startup", "startup_score", "goes_to")


@query("""
WITH h AS (SELECT DISTINCT l_orderkey AS o, lower(l_returnflag) AS k, l_suppkey % 3 AS s, l_tax >= 0.07 AS down FROM lineitem WHERE l_linenumber <= 2),
f AS (SELECT DISTINCT l_orderkey AS o, lower(l_returnflag) AS k, l_suppkey % 3 AS s FROM lineitem WHERE l_linenumber > 2)
SELECT f.o AS company_id, f.k AS key, f.s AS source_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.o = f.o AND h.k = f.k AND down) THEN 'held' WHEN EXISTS (SELECT 1 FROM h WHERE h.o = f.o AND h.k = f.k AND h.s = f.s) THEN 'refreshed' ELSE 'added' END AS outcome FROM f
""")
def enrichment_claims(spark: SparkSession, d: str) -> DataFrame:
    """The later lines of an order as a read, its first lines as claims held, some of them turned down."""
    held, found = _claims(spark, d)
    return enrichment.take_claims(held, found).select("company_id", "key", "source_id", "outcome")


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    confidence = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 15, "medium").otherwise("low")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("company_id"), F.lit("outcome").alias("field"), F.lower("l_returnflag").alias("key"), (F.col("l_suppkey") % 3).alias("source_id"), F.col("l_returnflag").alias("value"), confidence.alias("confidence"),
        F.col("l_shipdate").alias("verified_at"), F.when(F.col("l_tax") >= 0.07, "rejected").otherwise("active").alias("status"), "l_linenumber",
    )
    return rows.where("l_linenumber <= 2"), rows.where("l_linenumber > 2")


@query("""
WITH l AS (SELECT l_orderkey AS o, lower(l_returnflag) AS k, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 15 THEN 2 ELSE 1 END AS r, l_linenumber AS n FROM lineitem WHERE l_tax < 0.07),
p AS (SELECT o, count(DISTINCT k) AS n, min(k) AS k, max(r) AS best FROM l WHERE o IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2) GROUP BY o),
s AS (SELECT o_orderkey AS o, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'n' END AS st FROM orders),
a AS (SELECT p.o, CASE WHEN n > 1 THEN 'conflict' WHEN st = k THEN 'confirmed' WHEN st IS NOT NULL THEN 'differs' WHEN best = 3 THEN 'fill' ELSE 'suggest' END AS action, k, best FROM p LEFT JOIN s ON s.o = p.o)
SELECT o AS company_id, action, CASE WHEN action <> 'conflict' THEN upper(k) END AS value, CASE best WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS best FROM a
""")
def enrichment_fields(spark: SparkSession, d: str) -> DataFrame:
    """What the claims of an order with later lines mean for its record."""
    held, found = _claims(spark, d)
    active = held.unionByName(found).where("status = 'active'").withColumn("pos", F.col("l_linenumber"))
    k = F.col("o_orderkey")
    stored = table(spark, d, "orders").select(k.alias("company_id"), F.lit("outcome").alias("field"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "n").alias("stored_key"))
    return enrichment.fill_fields(active, found, stored, ("outcome",), True).select("company_id", "action", "value", "best")
