"""Rules of staging tables: candidates, tasks, rows of places, and the trail of who did what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.operators import validate
from tracefold.operators.dealing import dealt, tasks_for
from tracefold.plans.base import query
from tracefold.session import table


@query("""
WITH c AS (SELECT c_custkey AS k, 'cand-' || c_custkey AS id, c_custkey % 7 AS h, c_custkey % 5 AS w, c_custkey % 11 AS d FROM customer)
SELECT 'candidates' AS "table", id, unnest(list_filter([
  CASE WHEN h = 1 THEN 'history_step' END, CASE WHEN h = 2 THEN 'history_begins' END, CASE WHEN h = 3 THEN 'history_ends' END, CASE WHEN h = 4 THEN 'no_history' END, CASE WHEN h = 5 THEN 'history_says' END,
  CASE WHEN w = 1 THEN 'domain' END, CASE WHEN w = 2 THEN 'website' END, CASE WHEN w = 2 THEN 'domain' END, CASE WHEN d = 0 THEN 'no_discovery' END, CASE WHEN d = 1 THEN 'discovery' END, CASE WHEN d = 2 THEN 'abn' END, CASE WHEN d = 3 THEN 'state' END,
  CASE WHEN d = 4 THEN 'seen_before_discovered' END, CASE WHEN d = 5 THEN 'resolution' END, CASE WHEN h = 6 AND k % 3 = 0 THEN 'published_without_company' END, CASE WHEN h = 6 AND k % 3 = 1 THEN 'no_published_company_id' END], lambda x: x IS NOT NULL)) AS code FROM c
""")
def candidate_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers as candidates, each wrong in its own way; the companies that they became are the suppliers."""
    k = F.col("c_custkey")
    at = F.lit("2024-01-02").cast("timestamp")
    steps = lambda *s: F.array(*[F.struct(F.lit(x).alias("status"), at.alias("at"), F.lit("engine").alias("by")) for x in s])
    h = k % 7
    history = F.when(h == 1, steps("candidate", "approved")).when(h == 2, steps("needs_review", "approved")).when(h == 3, steps("candidate")).when(h == 4, F.slice(steps("candidate"), 1, 0))
    history = history.when(h == 5, F.array(F.struct(F.lit("candidate").alias("status"), at.alias("at"), F.lit(" ").alias("by")))).when(h == 6, steps("candidate", "needs_review", "approved", "published")).otherwise(steps("candidate", "needs_review"))
    status = F.when(h.isin(1, 2), "approved").when(h == 3, "matched").when(h.isin(4, 5), "candidate").when(h == 6, "published").otherwise("needs_review")
    discovery = lambda key: F.array(F.struct(F.lit("s").alias("source_id"), F.lit("press").alias("source_kind"), F.lit(key).alias("key"), at.alias("observed_at")))
    w, n = k % 5, k % 11
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("cand-"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), status.alias("status"), F.when(w == 0, "https://www.acme.com.au/x").when(w == 1, "https://acme.com.au").when(w == 2, "not a site").alias("website"),
        F.when(w == 0, "acme.com.au").when(w == 1, "acme.au").when(w == 2, "x.com").alias("domain"), F.when(n == 3, "XX").otherwise("WA").alias("state"), F.when(n == 2, "1").otherwise("51824753556").alias("abn"), F.lit(None).cast("string").alias("acn"),
        F.when(n == 5, "SAME").otherwise("NEW_COMPANY").alias("resolution"), F.when(n == 0, F.slice(discovery("k"), 1, 0)).when(n == 1, discovery("")).otherwise(discovery("k")).alias("discoveries"),
        at.alias("first_discovered_at"), F.when(n == 4, at - F.make_dt_interval(F.lit(1))).otherwise(at).alias("last_seen_at"), F.when((h == 6) & (k % 3 > 0), F.when(k % 3 == 1, -k).otherwise(1)).alias("published_company_id"), history.alias("status_history"),
    )
    return validate.candidates(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""
WITH t AS (SELECT event_id AS id, user_id * 4 + event_id % 4 AS target, event_type AS t, value AS v, ts FROM events),
s AS (SELECT *, CASE t WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' WHEN 'purchase' THEN 'failed' ELSE 'lost' END AS status FROM t),
a AS (SELECT min(id) AS id FROM s WHERE status IN ('queued', 'running') GROUP BY target HAVING count(*) > 1),
r AS (
  SELECT id, unnest(list_filter([CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN v < 1 THEN 'attempts' END, CASE WHEN status = 'running' AND v >= 20 THEN 'running_without_lease' END,
    CASE WHEN status = 'done' AND v > 30 THEN 'lease_without_running' END, CASE WHEN status IN ('done', 'failed') AND v < 10 THEN 'finished_at' END, CASE WHEN status IN ('queued', 'running') AND v > 40 THEN 'finished_too_early' END,
    CASE WHEN (status IN ('done', 'failed') AND v >= 10 OR status IN ('queued', 'running') AND v > 40) AND id % 13 = 0 THEN 'finished_before_created' END], lambda x: x IS NOT NULL)) AS code FROM s)
SELECT 'tasks' AS "table", id::VARCHAR AS id, code FROM r UNION ALL SELECT 'tasks', id::VARCHAR, 'two_active' FROM a
UNION ALL SELECT 'tasks', id::VARCHAR, 'no_target_id' FROM s WHERE target NOT IN (SELECT c_custkey FROM customer)
""")
def task_violations(spark: SparkSession, d: str) -> DataFrame:
    """Events as tasks about customers."""
    t, v, ts = F.col("event_type"), F.col("value"), F.col("ts")
    status = F.when(t == "signup", "queued").when(t == "click", "running").when(t == "view", "done").when(t == "purchase", "failed").otherwise("lost")
    ended = F.when(status.isin("done", "failed"), v >= 10).when(status.isin("queued", "running"), v > 40).otherwise(False)
    when = F.when(F.col("event_id") % 13 == 0, ts - F.make_dt_interval(F.lit(1))).otherwise(ts)
    lease = F.when(status == "running", v < 20).when(status == "done", v > 30).otherwise(False)
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.lit("company").alias("kind"), (F.col("user_id") * 4 + F.col("event_id") % 4).alias("target_id"), status.alias("status"), F.when(v >= 1, 1).otherwise(-1).alias("attempts"),
        F.when(lease, ts).alias("lease_until"), ts.alias("created_at"), F.when(ended, when).alias("finished_at"), F.lit(None).cast("timestamp").alias("not_before"),
    )
    return validate.tasks(rows, table(spark, d, "customer").select(F.lit("company").alias("kind"), F.col("c_custkey").alias("id")))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, CASE o_orderstatus WHEN 'F' THEN 'EXACT' WHEN 'O' THEN 'CITY' ELSE 'UNKNOWN' END AS p, o_orderkey % 5 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
k AS (SELECT *, CASE WHEN n = 1 OR m = 0 THEN 'HEADQUARTERS' ELSE 'OFFICE' END AS kind, CASE WHEN p = 'EXACT' AND m <> 1 THEN 1 END AS lat, CASE WHEN p = 'EXACT' AND m NOT IN (1, 2) THEN 1 END AS lng, CASE WHEN m <> 3 THEN '1 High St' END AS address FROM o),
h AS (SELECT * FROM k WHERE n = 1)
SELECT 'locations' AS "table", id::VARCHAR AS id, unnest(list_filter([CASE WHEN (lat IS NULL) <> (lng IS NULL) THEN 'half_a_point' END, CASE WHEN p = 'EXACT' AND lat IS NULL THEN 'no_point' END, CASE WHEN p = 'EXACT' AND address IS NULL THEN 'exact_without_address' END,
  CASE WHEN kind = 'OFFICE' AND p = 'UNKNOWN' THEN 'office_without_place' END], lambda x: x IS NOT NULL)) AS code FROM k
UNION ALL SELECT 'locations', min(id)::VARCHAR, 'two_headquarters' FROM k WHERE kind = 'HEADQUARTERS' GROUP BY c HAVING count(*) > 1
UNION ALL SELECT 'locations', k.id::VARCHAR, 'differs_from_company' FROM k JOIN h ON h.c = k.c WHERE k.kind = 'HEADQUARTERS' AND (k.p, k.lat, k.lng, k.address) IS DISTINCT FROM (h.p, h.lat, h.lng, h.address)
""")
def location_violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of places of customers; the first order of each is its headquarters."""
    orders = table(spark, d, "orders")
    n = tasks_for(orders)
    o = dealt(orders, n, "o_custkey").withColumn("first", F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    m, p = F.col("o_orderkey") % 5, F.when(F.col("o_orderstatus") == "F", "EXACT").when(F.col("o_orderstatus") == "O", "CITY").otherwise("UNKNOWN")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.when((F.col("o_orderkey") == F.col("first")) | (m == 0), "HEADQUARTERS").otherwise("OFFICE").alias("kind"), p.alias("precision"), F.when(m != 3, "1 High St").alias("address"), F.lit("Perth").alias("city"),
        F.when((p == "EXACT") & (m != 1), 1.0).alias("lat"), F.when((p == "EXACT") & ~m.isin(1, 2), 1.0).alias("lng"), "first",
    )
    return validate.location_rows(rows.drop("first"), rows.where("id = first").drop("first", "id", "kind"), n)


@query("""
WITH e AS (SELECT event_id, event_type AS t, value AS v, ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)
SELECT 'audit_trail' AS "table", CASE WHEN v < 1 THEN 'x' || event_id ELSE 'aud-1-' || event_id END AS id, unnest(list_filter([CASE WHEN v < 1 THEN 'id' END, CASE WHEN t = 'error' THEN 'action' END, CASE WHEN v > 60 THEN 'actor' END, CASE WHEN event_id % 50 = 7 THEN 'summary' END,
  CASE WHEN ts < before - INTERVAL 10 MINUTE THEN 'out_of_order' END], lambda x: x IS NOT NULL)) AS code FROM e
""")
def trail_violations(spark: SparkSession, d: str) -> DataFrame:
    """Events as a trail, in the order of their ids."""
    e, v = F.col("event_id"), F.col("value")
    rows = table(spark, d, "events").select(
        e.alias("pos"), F.concat(F.when(v < 1, "x").otherwise("aud-1-"), e.cast("string")).alias("id"), F.col("ts").alias("at"), F.when(v <= 60, "ann").otherwise(" ").alias("actor"), F.lit("admin").alias("role"), F.col("event_type").alias("action"),
        F.lit("company").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.when(e % 50 != 7, "did it").alias("summary"),
    )
    return validate.audit_trail(rows, ("signup", "click", "view", "purchase"), ("admin",))
