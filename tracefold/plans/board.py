"""The job board over orders (roles) and customers (employers)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import board as B
from tracefold.plans.base import query
from tracefold.session import table

AS_OF = datetime(2001, 8, 1)
ROLES_SQL = """(SELECT o_orderkey AS id, o_custkey AS company_id, CASE WHEN o_orderkey % 13 = 0 THEN 'Open application' ELSE 'Role ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 17 = 0 THEN 'http://x' ELSE 'https://x' END AS apply_url, CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS status, o_orderdate AS c, o_orderpriority AS priority, o_orderstatus FROM orders)"""


def roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("company_id"), F.when(k % 13 == 0, "Open application").otherwise(F.concat(F.lit("Role "), k.cast("string"))).alias("title"),
        F.when(k % 17 == 0, "http://x").otherwise("https://x").alias("apply_url"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"),
        F.col("o_orderdate").alias("last_confirmed_at"), F.col("o_orderpriority").alias("priority"), "o_orderstatus",
    )


@query(f"""
SELECT id, company_id, CASE WHEN epoch(TIMESTAMP '2001-08-01') - epoch(c) <= 48 * 3600 THEN 'confirmed' ELSE 'recheck' END AS confirmation, c_name AS employer FROM {ROLES_SQL} JOIN customer ON c_custkey = company_id
WHERE status = 'open' AND apply_url = 'https://x' AND title <> 'Open application' AND c >= TIMESTAMP '2001-08-01' - INTERVAL 14 DAY AND c_acctbal > 0
""")
def curated_jobs(spark: SparkSession, d: str) -> DataFrame:
    employers = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return B.curated(roles(spark, d), employers, F.lit(AS_OF)).select("id", "company_id", "confirmation", "employer")


@query(f"""
SELECT 'priority' AS facet, priority AS value, count(*)::BIGINT AS count FROM {ROLES_SQL} WHERE o_orderstatus IN ('O') GROUP BY priority
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM {ROLES_SQL} WHERE priority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus
UNION ALL SELECT 'status', status, count(*) FROM {ROLES_SQL} WHERE priority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O') GROUP BY status
""")
def facets_without_own(spark: SparkSession, d: str) -> DataFrame:
    return B.facet_counts(roles(spark, d), {"priority": ("1-URGENT", "2-HIGH"), "o_orderstatus": ("O",), "status": ()})


@query("""
WITH r AS (SELECT l_orderkey AS id, list_distinct(list(CASE WHEN l_suppkey % 4 <> 0 THEN 'city' || (l_suppkey % 4)::VARCHAR END)) AS c FROM lineitem GROUP BY l_orderkey),
p AS (SELECT id, unnest(CASE WHEN len(c) > 0 THEN c ELSE [''] END || ['*']) AS place FROM r)
SELECT place, count(DISTINCT id)::BIGINT AS roles FROM p GROUP BY place
""")
def roles_by_place(spark: SparkSession, d: str) -> DataFrame:
    city = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("city"), (F.col("l_suppkey") % 4).cast("string")))
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(city).alias("cities"))
    return B.place_counts(r, "id", "cities")


@query("""
WITH p AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 > 0 OR o_custkey % 4 = 1 THEN CASE WHEN o_custkey % 4 < 2 THEN 'remote' WHEN o_orderkey % 2 = 0 THEN 'hybrid' ELSE 'on_site' END END AS a FROM orders),
g AS (SELECT o_custkey, count(*) AS n, count(a) AS s, count(DISTINCT a) AS k, min(a) AS one FROM p GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n = s AND k = 1 THEN one END AS policy, CASE WHEN n = s AND k = 1 THEN 'all postings agree' WHEN s = 0 THEN 'no posting says' WHEN k > 1 THEN 'postings differ' ELSE 'some postings do not say' END AS reason FROM g
""")
def remote_policies(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col("o_custkey") % 4, F.col("o_orderkey")
    a = F.when((k % 6 > 0) | (c == 1), F.when(c < 2, "remote").when(k % 2 == 0, "hybrid").otherwise("on_site"))
    return B.remote_policy(table(spark, d, "orders").select("o_custkey", a.alias("a")), "o_custkey", "a")


@query("""
SELECT p_partkey, p_partkey % 2 = 0 AS python, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS go FROM part
""")
def technologies_named(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("We go far with "), F.when(k % 2 == 0, "Python").otherwise("pythonic"), F.when(k % 3 == 0, ", Go and more").otherwise(" and more to go"))
    t = B.technologies(text, {"Python": "python", "SQL": "sql"}, {"Go": "go"})
    return table(spark, d, "part").select("p_partkey", F.array_contains(t, "Python").alias("python"), F.array_contains(t, "Go").alias("go"))


@query("""
WITH p AS (SELECT c_nationkey AS g, c_acctbal AS lat, (c_custkey % 101)::DOUBLE AS lng FROM customer), m AS (SELECT g, quantile_cont(lat, 0.5) AS mlat, quantile_cont(lng, 0.5) AS mlng FROM p GROUP BY g)
SELECT g, round(first(mlat), 6) AS lat, round(first(mlng), 6) AS lng, round(quantile_cont(sqrt(pow(lat - mlat, 2) + pow(lng - mlng, 2)), 0.9), 6) AS spread FROM p JOIN m USING (g) GROUP BY g
""")
def city_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("lat"), (F.col("c_custkey") % 101).cast("double").alias("lng"))
    b = B.robust_bounds(p, "g", "lat", "lng")
    return b.select("g", *[F.round(c, 6).alias(c) for c in ("lat", "lng", "spread")])


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 50 AS author, 's' || p_size % 5 AS s, p_type, 'i' || p_partkey % 3 AS i, 'c' || p_partkey % 7 AS c, p_size > 25 AS remote, p_size % 9 > 0 AS open FROM part),
x AS (SELECT id, (s = 's2')::INTEGER AS sk, (p_type IN ('PROMO'))::INTEGER AS h, (i = 'i1')::INTEGER AS si, CASE WHEN c = 'c3' THEN 2 WHEN remote THEN 1 ELSE 0 END AS place FROM p WHERE open AND author <> 7 AND id % 10 <> 4)
SELECT id, (3 * sk + 3 * h + 2 * si + place)::INTEGER AS score FROM x WHERE (sk > 0 OR h > 0) AND 3 * sk + 3 * h + 2 * si + place >= 3 ORDER BY score DESC, id DESC LIMIT 6
""")
def project_recommendations(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    text = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    k = F.col("p_partkey")
    projects = part.select(
        k.alias("id"), (k % 50).alias("author_id"), F.array(text("s", F.col("p_size") % 5)).alias("skills_needed"), F.array(F.when(F.col("p_type") == "PROMO", "cofounder").otherwise("advisor")).alias("collaboration"),
        F.array(text("i", k % 3)).alias("interests"), text("c", k % 7).alias("city"), (F.col("p_size") > 25).alias("remote"), (F.col("p_size") % 9 > 0).alias("open"), k.alias("created_at"),
    )
    me = spark.createDataFrame([(7, ["s2"], ["cofounder"], ["i1"], "C3", True)], "id long, skills array<string>, looking_for array<string>, interests array<string>, city string, remote boolean")
    said = part.where("p_partkey % 10 = 4").select(k.alias("project_id"), F.lit(7).cast("long").alias("member_id"))
    return B.recommend_projects(me, projects, said)
