"""Reads, clocks, queues and logs; events stand for what sources report, users for sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions.dates import backoff_minutes, half_day_block, jitter
from tracefold.operators import incremental as I  # noqa: E741
from tracefold.plans.base import query
from tracefold.session import table

SPLIT, AS_OF = datetime(2024, 1, 16), datetime(2024, 1, 31)


@query("""
SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return I.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


def _totals(spark: SparkSession, d: str, before: bool) -> DataFrame:
    e = table(spark, d, "events")
    e = e.where(F.col("ts") < SPLIT) if before else e.where(F.col("ts") >= SPLIT)
    return e.groupBy((F.col("user_id") * 24 + F.hour("ts")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT user_id * 24 + hour(ts) AS id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
a AS (SELECT user_id * 24 + hour(ts) AS id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT coalesce(a.id, b.id)::BIGINT AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.id = b.id
""")
def diff_before_after(spark: SparkSession, d: str) -> DataFrame:
    return I.diff(_totals(spark, d, True), _totals(spark, d, False), "id", ["n"])


@query("""
WITH s AS (SELECT user_id AS source_id, event_id AS ext, event_id % 97 AS u, CASE event_id % 3 WHEN 0 THEN 'hidden' ELSE 'open' END AS status, ts FROM events WHERE event_type <> 'signup'),
r AS (SELECT user_id AS source_id, event_id AS ext FROM events WHERE event_type <> 'error' AND user_id % 10 <> 4),
x AS (SELECT DISTINCT source_id FROM r)
SELECT s.source_id, s.ext::VARCHAR AS external_id, CASE WHEN r.ext IS NOT NULL THEN CASE WHEN s.status = 'hidden' THEN 'reopened' ELSE 'updated' END
  WHEN x.source_id IS NULL THEN 'kept' WHEN s.status = 'open' THEN 'hidden' WHEN s.ts <= TIMESTAMP '2024-01-31' - INTERVAL 30 MINUTE THEN 'archived' ELSE 'kept' END AS action
FROM s LEFT JOIN r USING (source_id, ext) LEFT JOIN x ON x.source_id = s.source_id
UNION ALL SELECT r.source_id, r.ext::VARCHAR, 'added' FROM r ANTI JOIN s USING (source_id, ext)
""")
def absence_hide_archive(spark: SparkSession, d: str) -> DataFrame:
    # sign-ups are not stored yet, errors are no longer listed, and every tenth source was not read
    e = table(spark, d, "events")
    ext = F.col("event_id").cast("string")
    url = F.concat(F.lit("https://x.example/"), ext)
    stored = e.where("event_type <> 'signup'").select(
        F.col("user_id").alias("source_id"), ext.alias("external_id"), url.alias("url"), F.lit("t").alias("title"), F.when(F.col("event_id") % 3 == 0, "hidden").otherwise("open").alias("status"),
        F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_confirmed_at"), F.col("ts").alias("status_changed_at"), F.lit(0).alias("absent_reads"),
    )
    read = e.where("event_type <> 'error' AND user_id % 10 <> 4").select(F.col("user_id").alias("source_id"), ext.alias("external_id"), url.alias("url"), F.lit("t").alias("title"))
    return I.apply_read(stored, read, F.lit(AS_OF)).select("source_id", "external_id", "action")


@query("""
WITH r AS (SELECT event_id AS id, user_id, event_type, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN value > 20 THEN ts END AS posted, ts FROM events),
w AS (SELECT user_id, event_type, count(DISTINCT source) AS n, arg_min({'id': id, 's': source}, {'a': CASE WHEN posted IS NULL THEN 1 ELSE 0 END, 'b': ts, 'c': id}) AS w FROM r GROUP BY ALL)
SELECT r.id, CASE WHEN n > 1 AND source <> w.s THEN w.id END AS duplicate_of FROM r JOIN w USING (user_id, event_type)
""")
def role_dedup_winner(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source"), F.when(F.col("value") > 20, F.col("ts")).alias("posted"), "ts")
    return I.dedupe_roles(e, ["user_id", "event_type"], "source", "id", "posted", "ts").select("id", "duplicate_of")


STREAK_SQL = """
WITH o AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
"""


@query(STREAK_SQL + "SELECT user_id, event_type, min(ts) AS run_start, max(ts) AS run_end, count(*)::BIGINT AS length FROM g GROUP BY user_id, run, event_type")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return I.streaks(table(spark, d, "events"), ["user_id"], "ts", "event_type", "event_id")


@query(STREAK_SQL + "SELECT user_id, count(DISTINCT run) FILTER (WHERE event_type = 'signup')::BIGINT AS reopened FROM g GROUP BY user_id")
def reopen_count(spark: SparkSession, d: str) -> DataFrame:
    runs = I.streaks(table(spark, d, "events"), ["user_id"], "ts", "event_type", "event_id")
    return runs.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("reopened"))


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, before AS from_status, o_orderstatus AS to_status FROM h WHERE before IS NOT NULL AND NOT ((before = 'O' AND o_orderstatus IN ('P', 'F')) OR (before = 'P' AND o_orderstatus = 'F'))
""")
def status_transition_lag(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    bad = I.illegal_moves(h, "o_custkey", "at", "o_orderstatus", {"O": ("P", "F"), "P": ("F",)})
    return bad.select("o_custkey", F.col("at.o_orderkey").alias("o_orderkey"), "from_status", "to_status")


@query("""
WITH c AS (SELECT user_id, event_type, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 4 WHEN 'signup' THEN 3 WHEN 'error' THEN 2 ELSE 1 END AS imp, length(event_type) AS base, max(ts) + INTERVAL 1 DAY * length(event_type) AS nxt FROM events GROUP BY user_id, event_type),
n AS (SELECT user_id, imp, base, CASE WHEN user_id % 9 = 0 AND imp = 1 THEN NULL ELSE nxt - INTERVAL 12 DAY END AS nxt FROM c),
s AS (SELECT user_id, imp * 100 + CASE WHEN nxt IS NULL THEN 1000.0 ELSE least((epoch(TIMESTAMP '2024-01-31') - epoch(nxt))::BIGINT / 86400.0 / base, 10.0) * 50 END AS score FROM (SELECT * REPLACE (date_trunc('second', nxt) AS nxt) FROM n) WHERE nxt IS NULL OR nxt <= TIMESTAMP '2024-01-31')
SELECT user_id, count(*)::BIGINT AS facets, round(max(score), 4) AS score FROM s GROUP BY user_id ORDER BY score DESC, user_id LIMIT 15
""")
def due_plan_topk(spark: SparkSession, d: str) -> DataFrame:
    imp = F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "view", 4).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "error", 2).otherwise(1)
    base = F.length("event_type")
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    c = c.select("user_id", imp.alias("imp"), base.alias("base"), F.date_trunc("second", F.col("last") + F.make_dt_interval(base - 12)).alias("next_at"))
    c = c.withColumn("next_at", F.when((F.col("user_id") % 9 == 0) & (F.col("imp") == 1), None).otherwise(F.col("next_at")))
    return I.due_plan(c, F.lit(AS_OF), "user_id", "imp", "base", "next_at", 15)


@query("""
WITH f AS (SELECT user_id, count(*) % 9 AS failures FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, failures::BIGINT AS failures, CASE WHEN user_id % 7 = 0 THEN 1440.0 ELSE greatest(([15, 60, 180, 360, 720, 1440])[least(greatest(failures, 1), 6)]::DOUBLE, least(user_id * 120 / 60.0, 1440.0)) END::DOUBLE AS minutes, failures >= 3 AS attention FROM f
""")
def backoff_ladder(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg((F.count(F.lit(1)) % 9).alias("failures"))
    wait = backoff_minutes(F.col("failures"), F.col("user_id") % 7 != 0, F.col("user_id") * 120)
    return f.select("user_id", "failures", wait.alias("minutes"), I.needs_attention(F.col("failures")).alias("attention"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "queued").otherwise("done")
    return e.select(
        F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 50).alias("priority"), F.col("ts").alias("created_at"), (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("lease_until"), F.when(F.col("event_id") % 6 == 1, F.col("ts") + F.make_dt_interval(F.lit(20))).alias("not_before"),
    )


@query("""
SELECT event_id AS id, CAST(event_id % 50 AS BIGINT) AS priority FROM events WHERE event_id % 3 = 1 AND (event_id % 6 <> 1 OR ts + INTERVAL 20 DAY <= TIMESTAMP '2024-01-31') ORDER BY priority DESC, ts, id LIMIT 20
""")
def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return I.claim_next(_tasks(spark, d), F.lit(AS_OF), 20).select("id", "priority")


@query("""
WITH t AS (SELECT event_id AS id, event_id % 3 AS s, event_id % 4 AS a, ts FROM events)
SELECT id, CASE WHEN s = 0 THEN CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'running' WHEN a + 1 < 3 THEN 'queued' ELSE 'failed' END WHEN s = 1 THEN 'queued' ELSE 'done' END AS status,
(CASE WHEN s = 0 AND ts <= TIMESTAMP '2024-01-20' THEN a + 1 ELSE a END)::INTEGER AS attempts FROM t
""")
def lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    return I.expire_leases(_tasks(spark, d), F.lit(datetime(2024, 1, 20))).select("id", "status", "attempts")


@query("""
SELECT event_id, floor(epoch(date_trunc('second', ts)) / 43200)::BIGINT AS block, round(1 + 0.15 * (2 * (('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0) - 1), 9) AS jitter FROM events
""")
def jitter_and_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", half_day_block(F.col("ts")).alias("block"), F.round(jitter(F.col("event_id").cast("string"), 0.15), 9).alias("jitter"))


@query("""
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def daily_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*)::BIGINT AS n FROM s GROUP BY user_id, k
""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.lag("ts").over(w)
    e = table(spark, d, "events").withColumn("c", F.when(F.col("ts") <= gap + F.make_dt_interval(F.lit(0), F.lit(6)), 0).otherwise(1))
    e = e.withColumn("k", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "k").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("k")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-16' AND value < 1 ORDER BY event_id")
def append_only_breaks(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").where(F.col("ts") < SPLIT).select("event_id", "ts", "value")
    return I.append_only_breaks(log, log.where("value >= 1")).select("event_id")


@query()
def stream_streaks(spark: SparkSession, d: str) -> DataFrame:
    """The run with which each user's log ends, by a stateful stream over the events; held against `streaks` in tests."""
    from tracefold.streaming.reads import StreakTable
    from tracefold.shared import fresh_path

    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    log = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    base = fresh_path(spark, "streaks")
    return StreakTable(spark, f"{base}/runs").run(log, f"{base}/checkpoint")
