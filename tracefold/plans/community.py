"""Threads, visibility and matching of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import folds
from tracefold.operators import relations as R
from tracefold.plans.base import query
from tracefold.session import table


@query("""
SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (WHERE role = 'user')::BIGINT AS asked, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS answered, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id
""")
def thread_counts(spark: SparkSession, d: str) -> DataFrame:
    return folds.threads(table(spark, d, "conversations"), "conv_id", "role", "turn", {"asked": "user", "answered": "assistant"})


@query("""
SELECT event_type, user_id % 20 AS item, count(DISTINCT user_id)::BIGINT AS reporters FROM events WHERE value > 20 GROUP BY ALL HAVING count(DISTINCT user_id) >= 3
""")
def distinct_reporters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 20").withColumn("item", F.col("user_id") % 20)
    return folds.reported(e, ["event_type", "item"], "user_id")


@query("""
SELECT conv_id, turn, role FROM conversations WHERE (turn % 4 <> 3 OR conv_id % 5 = 2) AND role <> 'system' ORDER BY conv_id DESC, turn DESC LIMIT 30
""")
def feed_visible_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a feed: every fourth turn is hidden from all but its author, who is asking."""
    status = F.when(F.col("turn") % 4 == 3, "hidden").otherwise("visible")
    c = table(spark, d, "conversations").where("role <> 'system'").withColumns({"status": status, "author": F.col("conv_id") % 5})
    return folds.visible_to(c, F.lit(2)).orderBy(F.desc("conv_id"), F.desc("turn")).limit(30).select("conv_id", "turn", "role")


SEGMENT_GOAL = {"BUILDING": "cofounder", "MACHINERY": "talent", "AUTOMOBILE": "job", "HOUSEHOLD": "meet", "FURNITURE": "feedback"}


def people(spark: SparkSession, d: str) -> DataFrame:
    goal = F.lit(None).cast("string")
    for k, v in SEGMENT_GOAL.items():
        goal = F.when(F.col("c_mktsegment") == k, v).otherwise(goal)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.array(goal).alias("looking_for"), F.array(F.concat(F.lit("s"), (F.col("c_custkey") % 7).cast("string"))).alias("skills"),
        F.array(F.concat(F.lit("i"), (F.col("c_custkey") % 5).cast("string"))).alias("interests"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("city"),
        (F.col("c_acctbal") > 5000).alias("remote"), F.array(F.concat(F.lit("o"), (F.col("c_custkey") % 3).cast("string"))).alias("open_to"), F.col("c_custkey").alias("created_at"),
    )


FITS_SQL = " OR ".join(f"(a.g = '{k}' AND b.g IN ({', '.join(repr(v) for v in vs)}))" for k, vs in R.FITS.items())


@query(f"""
WITH p AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'cofounder' WHEN 'MACHINERY' THEN 'talent' WHEN 'AUTOMOBILE' THEN 'job' WHEN 'HOUSEHOLD' THEN 'meet' ELSE 'feedback' END AS g,
  c_custkey % 7 AS s, c_custkey % 5 AS i, c_nationkey AS c, c_acctbal > 5000 AS remote, c_custkey % 3 AS o FROM customer),
x AS (SELECT a.id AS me_id, b.id, CASE WHEN {FITS_SQL} THEN 1 ELSE 0 END AS goals,
  least((CASE WHEN a.g IN ('cofounder', 'talent') AND a.s <> b.s THEN 1 ELSE 0 END) + (CASE WHEN b.g IN ('cofounder', 'talent') AND a.s <> b.s THEN 1 ELSE 0 END), 2) AS skills,
  (a.i = b.i)::INTEGER AS interests, CASE WHEN a.c = b.c THEN 2 WHEN a.remote AND b.remote THEN 1 ELSE 0 END AS place, (a.o = b.o)::INTEGER AS ways
  FROM p a JOIN p b ON a.id <> b.id WHERE a.id = (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AND NOT (b.id = a.id + 7)),
y AS (SELECT me_id, id, 3 * goals + 2 * skills + 2 * interests + place + ways AS score FROM x WHERE goals > 0 OR skills > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY me_id ORDER BY score DESC, id DESC) AS rank FROM y WHERE score >= 4)
SELECT me_id, id, score::INTEGER AS score, rank::INTEGER AS rank FROM r WHERE rank <= 6
""")
def match_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    """Who fits the customer of the highest balance, among all others."""
    p = people(spark, d)
    richest = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(1).select(F.col("c_custkey").alias("id"))
    me = p.join(richest, "id", "left_semi")
    met = me.select(F.col("id").alias("me_id"), (F.col("id") + 7).alias("other_id"))
    return R.recommend(me, p, met)
