"""Logs folded to state; events stand for what people do to posts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import folds as O
from tracefold.plans.base import query
from tracefold.session import table

ACTIONS = {"signup": "create", "purchase": "edit", "click": "like", "view": "unlike", "error": "report"}
LOG_SQL = """(SELECT event_id % 400 AS post_id, user_id AS actor, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'edit' WHEN 'click' THEN 'like' WHEN 'view' THEN 'unlike' ELSE CASE WHEN value > 24 THEN 'delete' WHEN value < 2 THEN 'restore' ELSE 'report' END END AS action,
  't' || event_id AS text, ts, event_id AS seq FROM events)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "error", F.when(F.col("value") > 24, "delete").when(F.col("value") < 2, "restore").otherwise("report"))
    for k, v in ACTIONS.items():
        if k != "error":
            action = action.when(F.col("event_type") == k, v)
    return e.select((F.col("event_id") % 400).alias("post_id"), F.col("user_id").alias("actor"), action.alias("action"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(f"""
WITH l AS (SELECT * FROM {LOG_SQL}),
a AS (SELECT post_id, actor, arg_max(action, {{'t': ts, 's': seq}}) AS last FROM l WHERE action IN ('like', 'unlike') GROUP BY ALL),
k AS (SELECT post_id, count(*) FILTER (WHERE last = 'like') AS likes FROM a GROUP BY post_id),
s AS (SELECT post_id, max({{'t': ts, 's': seq}}) AS since FROM l WHERE action = 'restore' GROUP BY post_id),
r AS (SELECT l.post_id, count(DISTINCT actor) AS reporters FROM l LEFT JOIN s USING (post_id) WHERE action = 'report' AND (since IS NULL OR {{'t': ts, 's': seq}} > since) GROUP BY l.post_id),
t AS (SELECT post_id, arg_max(text, {{'t': ts, 's': seq}}) AS text FROM l WHERE action IN ('create', 'edit') GROUP BY post_id)
SELECT post_id, text, CASE WHEN post_id IN (SELECT post_id FROM l WHERE action = 'delete') THEN 'deleted' WHEN reporters >= 3 THEN 'hidden' ELSE 'visible' END AS status, coalesce(likes, 0)::BIGINT AS likes, coalesce(reporters, 0)::BIGINT AS reporters
FROM t LEFT JOIN k USING (post_id) LEFT JOIN r USING (post_id)
""")
def posts_from_log(spark: SparkSession, d: str) -> DataFrame:
    return O.posts(log(spark, d))


@query("""
WITH RECURSIVE l AS (
  SELECT user_id * 100 + event_id % 100 AS id, CASE event_type WHEN 'signup' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'reopen' WHEN 'purchase' THEN 'publish' ELSE 'merge' END AS action,
    row_number() OVER (PARTITION BY user_id * 100 + event_id % 100 ORDER BY ts, event_id) AS n FROM events),
m(status, action, then_) AS (VALUES ('pending', 'approve', 'approved'), ('pending', 'reject', 'rejected'), ('pending', 'merge', 'merged'), ('rejected', 'reopen', 'pending'),
  ('approved', 'publish', 'published'), ('approved', 'reject', 'rejected'), ('approved', 'reopen', 'pending')),
w AS (
  SELECT DISTINCT id, 0::BIGINT AS n, 'pending' AS status, 0 AS applied, 0 AS refused FROM l
  UNION ALL
  SELECT w.id, l.n, coalesce(m.then_, w.status), applied + CASE WHEN m.then_ IS NULL THEN 0 ELSE 1 END, refused + CASE WHEN m.then_ IS NULL THEN 1 ELSE 0 END
  FROM w JOIN l ON l.id = w.id AND l.n = w.n + 1 LEFT JOIN m ON m.status = w.status AND m.action = l.action)
SELECT id, arg_max(status, n) AS status, arg_max(applied, n)::INTEGER AS applied, arg_max(refused, n)::INTEGER AS refused FROM w GROUP BY id
""")
def candidate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each user as a candidate; tests hold the fold against a plain loop too."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "signup", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "reopen").when(F.col("event_type") == "purchase", "publish").otherwise("merge")
    rows = e.select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("id"), action.alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return O.decide(rows, "pending", O.CANDIDATE_MOVES)


@query("""
WITH r AS (SELECT event_id AS id, user_id AS f, (user_id * 7 + event_id % 5) % 150 AS t, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'accepted' ELSE 'declined' END AS status, ts FROM events),
w AS (SELECT f, count(*) AS waiting FROM r WHERE status = 'pending' GROUP BY f),
l AS (SELECT unnest(arg_max({'f': f, 't': t, 'status': status, 'ts': ts}, {'a': ts, 'b': id})) FROM r GROUP BY least(f, t), greatest(f, t)),
x AS (SELECT l.f, t, CASE WHEN status = 'pending' THEN 'already asked' WHEN status = 'accepted' THEN 'already introduced' WHEN ts > TIMESTAMP '2024-02-20' - INTERVAL 30 DAY THEN 'declined lately' WHEN coalesce(waiting, 0) >= 8 THEN 'too many waiting' END AS reason FROM l LEFT JOIN w ON l.f = w.f)
SELECT f AS "from", t AS "to", reason IS NULL AS allowed, reason FROM x
""")
def introductions_allowed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "accepted").otherwise("declined")
    r = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("from"), ((F.col("user_id") * 7 + F.col("event_id") % 5) % 150).alias("to"), status.alias("status"), F.col("ts").alias("at"))
    return O.may_introduce(r, F.lit(datetime(2024, 2, 20)))
