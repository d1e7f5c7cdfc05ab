"""Audits, duplicates and constraint checks over the star schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.dates import age_days, is_stale
from tracefold.operators import quality as Q
from tracefold.plans.base import query
from tracefold.session import table

AS_OF = datetime(2001, 8, 1)


@query("""
WITH u AS (
  SELECT 'name' AS attribute, CASE WHEN c_name IS NULL THEN 'null' WHEN trim(c_name) = '' THEN 'empty' ELSE 'present' END AS state FROM customer
  UNION ALL SELECT 'segment', CASE WHEN c_mktsegment IS NULL THEN 'null' WHEN c_mktsegment = 'BUILDING' THEN 'unknown' WHEN c_mktsegment = 'FURNITURE' THEN 'empty' ELSE 'present' END FROM customer
  UNION ALL SELECT 'balance', CASE WHEN c_acctbal < 0 THEN 'null' ELSE 'present' END FROM customer)
SELECT attribute, state, count(*)::BIGINT AS count FROM u GROUP BY ALL
""")
def attribute_states(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumns(
        {"segment": F.when(F.col("c_mktsegment") == "BUILDING", "N/A").when(F.col("c_mktsegment") == "FURNITURE", " ").otherwise(F.col("c_mktsegment")), "balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))}
    )
    return Q.attribute_states(c, {"name": ("c_name", "string"), "segment": ("segment", "string"), "balance": ("balance", "number")})


TASKS = {"missing_website": (1, 70), "unknown_city": (1, 60), "stale_hiring": (2, 40), "missing_founders": (3, 12), "no_source": (3, 4)}


@query("""
WITH t AS (SELECT c.*, n.o FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) n ON c_custkey = o_custkey),
u AS (SELECT c_custkey AS id, c_name AS name, coalesce(o, 0) AS prominence, unnest([
  CASE WHEN c_acctbal < 0 THEN {'tier': 1, 'weight': 70, 'code': 'missing_website'} END, CASE WHEN c_nationkey = 7 THEN {'tier': 1, 'weight': 60, 'code': 'unknown_city'} END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN {'tier': 2, 'weight': 40, 'code': 'stale_hiring'} END, CASE WHEN c_acctbal > 9000 THEN {'tier': 3, 'weight': 12, 'code': 'missing_founders'} END,
  CASE WHEN o IS NULL THEN {'tier': 3, 'weight': 4, 'code': 'no_source'} END]) AS h FROM t),
g AS (SELECT id, name, prominence, min(h.tier) AS tier, sum(h.weight) AS score, string_agg(h.code, ',' ORDER BY h.tier, h.weight, h.code) AS tasks FROM u WHERE h IS NOT NULL GROUP BY ALL)
SELECT id, name, tier::INTEGER AS tier, score::INTEGER AS score, tasks, (row_number() OVER (ORDER BY tier, score DESC, prominence DESC, name, id))::INTEGER AS rank FROM g
ORDER BY rank LIMIT 100
""")
def task_queue_rank(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("o"))
    c = table(spark, d, "customer").join(n, "c_custkey", "left")
    conditions = {
        "missing_website": F.col("c_acctbal") < 0, "unknown_city": F.col("c_nationkey") == 7, "stale_hiring": F.col("c_mktsegment") == "BUILDING",
        "missing_founders": F.col("c_acctbal") > 9000, "no_source": F.col("o").isNull(),
    }
    queue = Q.task_queue(c, "c_custkey", "c_name", conditions, F.coalesce("o", F.lit(0)), TASKS)
    return Q.rank_queue(queue, 100).select("id", "name", "tier", "score", "tasks", "rank")


@query("""
SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01')::BIGINT AS age, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') > 180 AS stale FROM orders WHERE o_orderstatus = 'O'
""")
def staleness_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return o.select("o_orderkey", age_days(F.col("o_orderdate"), F.lit(AS_OF)).alias("age"), is_stale(F.col("o_orderdate"), F.lit(AS_OF), 180).alias("stale"))


@query("""
WITH u AS (SELECT 'same name' AS reason, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, p_partkey AS id FROM part UNION ALL SELECT 'same brand and size', p_brand || '|' || p_size, p_partkey FROM part)
SELECT reason, key, count(*)::BIGINT AS rows, min(id) AS first_id FROM u GROUP BY ALL HAVING count(*) > 1
""")
def possible_duplicates(spark: SparkSession, d: str) -> DataFrame:
    keys = {"same name": F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", ""), "same brand and size": F.concat_ws("|", "p_brand", F.col("p_size").cast("string"))}
    return Q.possible_duplicates(table(spark, d, "part"), keys, "p_partkey")


@query("""
WITH v AS (SELECT CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS label FROM part),
c AS (SELECT regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS key, label, count(*) AS n FROM v GROUP BY ALL)
SELECT key, count(*)::BIGINT AS spellings, sum(n)::BIGINT AS rows FROM c GROUP BY key HAVING count(*) > 1
""")
def label_variants(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return Q.label_variants(table(spark, d, "part").select(label.alias("label")), "label")


@query("""
SELECT 'lineitem' AS "table", l_orderkey::VARCHAR AS id, 'no_partkey' AS code FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 13)
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'no_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900)
""")
def fk_violations_anti(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "partkey")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")
    return Q.all_violations([
        Q.orphans("lineitem", li, "l_orderkey", "partkey", table(spark, d, "part").where("p_size <> 13"), "p_partkey"),
        Q.orphans("orders", o, "o_orderkey", "custkey", table(spark, d, "customer").where("c_acctbal > -900"), "c_custkey"),
    ])


@query("""
SELECT 'part' AS "table", p_name || '|' || p_brand AS id, 'not_unique' AS code FROM part GROUP BY p_name, p_brand HAVING count(*) > 1
""")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return Q.not_unique("part", table(spark, d, "part"), ["p_name", "p_brand"])


@query("""
SELECT 'orders' AS "table", o_orderkey::VARCHAR AS id, unnest(list_filter([CASE WHEN NOT o_totalprice > 2000 THEN 'price_small' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]') THEN 'bad_priority' END,
CASE WHEN o_orderstatus = 'F' AND NOT o_orderdate <= TIMESTAMP '2001-07-01' THEN 'late_close' END], lambda x: x IS NOT NULL)) AS code FROM orders
""")
def row_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "price_small": F.col("o_totalprice") > 2000,
        "bad_priority": F.col("o_orderpriority").rlike("^[1-4]"),
        "late_close": F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") <= F.lit(datetime(2001, 7, 1))),
    }
    return Q.violations("orders", table(spark, d, "orders"), "o_orderkey", rules)
