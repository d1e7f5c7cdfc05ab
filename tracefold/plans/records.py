"""Derived states, slugs, merges, imports and scores over the star schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import addresses as A
from tracefold.functions.dates import fresh
from tracefold.functions.registry_numbers import is_abn, is_acn
from tracefold.operators import imports as I  # noqa: E741
from tracefold.operators import records as R
from tracefold.plans.base import query
from tracefold.session import table

AS_OF = datetime(2001, 7, 20)


@query("""
SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) WHEN 3 THEN 'x' ELSE 'y' END AS seen, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey
""")
def grouped_states(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.max(rank) == 3, "x").otherwise("y").alias("seen"), F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN c_acctbal > 2000 AND last >= TIMESTAMP '2001-07-20' - INTERVAL 90 DAY THEN 'hiring' WHEN c_acctbal > 2000 THEN 'checked' WHEN c_acctbal < 0 AND last IS NOT NULL THEN 'none' ELSE 'unverified' END AS state
FROM customer LEFT JOIN l ON o_custkey = c_custkey
""")
def hiring_states(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    c = table(spark, d, "customer").join(last, "c_custkey", "left")
    status = F.when(F.col("c_acctbal") < 0, "not_hiring")
    return c.select("c_custkey", R.hiring_state(F.col("c_acctbal") > 2000, status, F.col("last"), F.col("last"), F.lit(AS_OF), 90).alias("state"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '2001-07-06' AND TIMESTAMP '2001-07-21' THEN 'funding' WHEN o_orderstatus <> 'F' AND o_orderdate BETWEEN TIMESTAMP '2001-07-06' AND TIMESTAMP '2001-07-21' THEN 'role' END AS kind FROM orders
""")
def fresh_in_two_weeks(spark: SparkSession, d: str) -> DataFrame:
    f = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    r = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", fresh(f, r, F.lit(AS_OF))["kind"].alias("kind"))


@query("""
SELECT o_custkey, min(o_orderdate) FILTER (WHERE o_orderdate::DATE >= DATE '2001-07-20' AND o_orderdate::DATE < DATE '2001-08-04')::DATE AS next FROM orders GROUP BY o_custkey
""")
def upcoming_event(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.to_date("o_orderdate")).alias("dates"))
    return dates.select("o_custkey", R.upcoming(F.col("dates"), F.lit(AS_OF)).alias("next"))


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'defunct' WHEN p_type = 'SMALL' THEN 'acquired' END AS lifecycle, CASE WHEN p_size % 5 <> 0 THEN p_name END AS label FROM part
""")
def lifecycle_and_nulls(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("p_type") == "SMALL", "acquired")
    stage = F.when(F.col("p_type") == "PROMO", "Defunct (in liquidation)")
    label = F.when(F.col("p_size") % 10 == 0, "Unknown").when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", R.lifecycle(status, stage).alias("lifecycle"), R.known(label).alias("label"))


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (
  SELECT p_partkey, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
""")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_slugs(table(spark, d, "part"), "p_name", "p_partkey", folded=True).select("p_partkey", "slug")


@query("""
WITH s AS (SELECT o_orderkey, 'status' AS field, o_orderstatus AS v, CASE WHEN o_totalprice > 200000 THEN 3 ELSE 1 END AS c FROM orders),
f AS (SELECT l_orderkey AS o_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'status' ELSE 'stage' END AS field, max(l_linestatus) AS v, 2 AS c FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(s.o_orderkey, f.o_orderkey) AS o_orderkey, coalesce(s.field, f.field) AS field, s.v AS sv, f.v AS fv, s.c AS sc, f.c AS fc FROM s FULL JOIN f ON s.o_orderkey = f.o_orderkey AND s.field = f.field)
SELECT o_orderkey, field, CASE WHEN fv IS NULL THEN 'kept' WHEN sv IS NULL THEN 'added' WHEN sv = fv THEN 'confirmed' WHEN fc > sc THEN 'replaced' ELSE 'conflict' END AS action,
CASE WHEN fv IS NULL THEN sc WHEN sv IS NULL THEN fc WHEN sv = fv THEN greatest(sc, fc) WHEN fc > sc THEN fc ELSE sc END::INTEGER AS confidence FROM j
""")
def merge_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stored = o.select("o_orderkey", F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_totalprice") > 200000, 3).otherwise(1).alias("confidence"))
    field = F.when(F.col("l_orderkey") % 2 == 0, "status").otherwise("stage")
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), field.alias("field")).agg(F.max("l_linestatus").alias("value")).withColumn("confidence", F.lit(2))
    return R.merge_claims(stored, found, ["o_orderkey", "field"], ["hiring_status"]).select("o_orderkey", "field", "action", "confidence")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 10 = 3 THEN l_suppkey - 3 ELSE l_suppkey END AS l_suppkey FROM lineitem
""")
def merged_investor_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    merges = s.where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") - 3).alias("new"))
    return R.rewrite_keys(table(spark, d, "lineitem"), "l_suppkey", merges).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH v AS (SELECT CASE WHEN p_size % 4 = 0 THEN upper(p_name) ELSE p_name END AS s FROM part), c AS (SELECT lower(s) AS key, s, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, s) AS k FROM c)
SELECT key, max(s) FILTER (WHERE k = 1) AS name, count(*)::BIGINT AS spellings, sum(n)::BIGINT AS rows FROM r GROUP BY key
""")
def names_to_entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("s"))
    return I.entities_of(p, "s", F.lower("s"))


@query("""
WITH k AS (SELECT p_partkey AS id, p_name || p_brand AS key FROM part), o AS (SELECT key, min(id) AS record_id FROM k GROUP BY key HAVING count(*) = 1)
SELECT id AS item_id, record_id FROM k JOIN o USING (key)
""")
def match_unique_only(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("key"))
    return I.match_unique(k, k, "key")


@query("""
WITH q AS (SELECT l_orderkey AS id, avg(b) AS quality FROM (SELECT l_orderkey, l_returnflag, max(CASE WHEN l_quantity > 40 THEN 1.0 WHEN l_quantity > 15 THEN 0.6 ELSE 0.3 END)::DOUBLE AS b FROM lineitem GROUP BY ALL) GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS id, 0.4 * greatest(o_totalprice / 500000 - 0.2, 0) + 0.35 * greatest((o_orderkey % 10) / 10.0 - 0.1013, 0) + 0.25 * coalesce(quality, 0.1) AS raw, o_orderstatus AS s FROM orders LEFT JOIN q ON id = o_orderkey)
SELECT id, round(CASE WHEN s = 'P' THEN least(CASE WHEN s = 'F' THEN least(raw, 0.5) ELSE raw END, 0.6) ELSE CASE WHEN s = 'F' THEN least(raw, 0.5) ELSE raw END END, 2)::DOUBLE AS score FROM r
""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000 - 0.2).alias("australian"), ((F.col("o_orderkey") % 10) / 10.0 - 0.1013).alias("startup"),
        (F.col("o_orderstatus") == "F").alias("duplicate"), F.when(F.col("o_orderstatus") != "P", "https://x.example").alias("website"),
    )
    confidence = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 15, "medium").otherwise("low")
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("field"), confidence.alias("confidence"))
    return I.score_candidates(c, e)


@query("""
WITH s AS (SELECT user_id AS id, event_type AS code, round(value / 100 - 0.25, 2) AS w FROM events), b AS (SELECT id, code, arg_max(w, {'a': abs(w), 'w': w}) AS w FROM s GROUP BY ALL),
t AS (SELECT id, round(greatest(-1.0, least(1.0, sum(w))), 4) AS total, min(w) AS low FROM b GROUP BY id)
SELECT id, total, CASE WHEN total >= 0.6 THEN 'yes' WHEN total >= 0.3 THEN 'likely' WHEN total <= -0.2 AND low < 0 THEN 'no' ELSE 'unclear' END AS verdict FROM t
""")
def signal_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("code"), F.round(F.col("value") / 100 - 0.25, 2).alias("weight"))
    return I.sum_signals(s, 0.6, 0.3, -0.2)


@query("""
WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000007)::VARCHAR, 9, '0') AS acn, lpad((10000000000 + c_custkey * 104729)::VARCHAR, 11, '0') AS abn FROM customer),
n AS (SELECT c_custkey, acn, list_sum(list_transform(range(1, 9), lambda i: acn[i]::INTEGER * (9 - i))) AS s,
  list_sum(list_transform(range(1, 12), lambda i: (abn[i]::INTEGER - CASE WHEN i = 1 THEN 1 ELSE 0 END) * [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19][i])) AS t FROM d)
SELECT c_custkey, (10 - s % 10) % 10 = acn[9]::INTEGER AND length(acn) = 9 AS acn_ok, t % 89 = 0 AS abn_ok FROM n
""")
def registry_checksums(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    acn = F.lpad((key * 7919 % 1000000007).cast("string"), 9, "0")
    abn = F.lpad((F.lit(10000000000) + key * 104729).cast("string"), 11, "0")
    return table(spark, d, "customer").select("c_custkey", is_acn(acn).alias("acn_ok"), is_abn(abn).alias("abn_ok"))


@query("""
SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'NSW' WHEN 1 THEN 'VIC' END AS state, (2000 + c_custkey % 900)::VARCHAR AS postcode, c_custkey::VARCHAR || ' creek street' AS street FROM customer
""")
def address_parts(spark: SparkSession, d: str) -> DataFrame:
    key, code = F.col("c_custkey").cast("string"), (2000 + F.col("c_custkey") % 900).cast("string")
    k = F.col("c_nationkey") % 3
    address = F.when(k == 0, F.concat(F.lit("Level 7, "), key, F.lit(" Creek St, Sydney NSW "), code)).when(k == 1, F.concat(F.lit("2/"), key, F.lit(" Creek Street, Glebe "), code, F.lit(", VIC"))).otherwise(F.concat(F.lit("Suite 1.10/"), key, F.lit(" Creek ST, "), code))
    c = table(spark, d, "customer").select("c_custkey", address.alias("a"))
    return c.select("c_custkey", A.state(F.col("a")).alias("state"), A.postcode(F.col("a")).alias("postcode"), A.street(F.col("a")).alias("street"))


@query("""
WITH s AS (SELECT user_id AS id, count(*) AS checks FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
o AS (SELECT user_id AS id, arg_max(event_type, ts) AS e FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT coalesce(s.id, o.id) AS id, (coalesce(checks, 0) + CASE WHEN e IS NULL THEN 0 ELSE 1 END)::BIGINT AS checks,
CASE WHEN e IN ('view', 'click') THEN 3 + 1 WHEN e IN ('signup', 'purchase') THEN 0 ELSE 3 END::INTEGER AS unchanged_streak, CASE WHEN e = 'error' THEN 2 + 1 WHEN e IS NULL THEN 2 ELSE 0 END::INTEGER AS failures FROM s FULL JOIN o ON s.id = o.id
""")
def facet_clock_stamps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    split = F.lit(datetime(2024, 1, 16))
    none = F.lit(None)
    state = e.where(F.col("ts") < split).groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("checks")).withColumns(
        {"unchanged_streak": F.lit(3), "failures": F.lit(2), "last_checked_at": none.cast("timestamp"), "last_changed_at": none.cast("timestamp"), "last_outcome": none.cast("string")}
    )
    outcome = F.when(F.col("k") == "error", "failed").when(F.col("k").isin("view", "click"), "unchanged").otherwise("changed")
    checks = e.where(F.col("ts") >= split).groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "ts").alias("k"), F.max("ts").alias("at")).withColumn("outcome", outcome).drop("k")
    return R.stamp_checks(state, checks).select("id", "checks", "unchanged_streak", "failures")
