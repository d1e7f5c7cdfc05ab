"""Portfolios, related investors, overlaps and edges; suppliers stand for investors, parts for companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import geo
from tracefold.operators import relations as R
from tracefold.plans.base import query
from tracefold.session import table


@query("SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS items FROM lineitem GROUP BY l_suppkey")
def portfolio_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    return R.portfolio(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""
WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
c AS (SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY shared DESC, other) AS rank FROM c)
SELECT l_suppkey, other, shared::BIGINT AS shared, rank::INTEGER AS rank FROM r WHERE rank <= 6
""")
def co_supplier_related_top6(spark: SparkSession, d: str) -> DataFrame:
    return R.related(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rank FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate, rank::INTEGER AS rank FROM r WHERE rank <= 5
""")
def recent_top5(spark: SparkSession, d: str) -> DataFrame:
    return R.recent(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate", "rank")


@query("""
WITH p AS (SELECT l_partkey, min(l_extendedprice) AS low, CASE WHEN count(*) > 20 THEN max(l_extendedprice) END AS high FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, low, high FROM p WHERE coalesce(low <= 5000, true) AND coalesce(high >= 60000, true)
""")
def range_overlap_price(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count(F.lit(1)).alias("n"))
    p = p.select("l_partkey", "low", F.when(F.col("n") > 20, F.col("high")).alias("high"))
    return p.where(R.ranges_overlap(F.col("low"), F.col("high"), 60000, 5000))


RANGES_SQL = ", ".join(str(r) for r in geo.METRO_RANGES)


@query(f"""
WITH m(state, low, high, metro) AS (VALUES {RANGES_SQL}),
c AS (SELECT c_custkey, 1990 + (c_custkey * 37) % 2000 AS postcode, CASE c_nationkey % 3 WHEN 0 THEN 'NSW' WHEN 1 THEN 'VIC' ELSE 'QLD' END AS state FROM customer)
SELECT c_custkey, c.state, metro FROM c LEFT JOIN m ON c.state = m.state AND postcode BETWEEN low AND high
""")
def metro_range_join(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("c_nationkey") % 3 == 0, "NSW").when(F.col("c_nationkey") % 3 == 1, "VIC").otherwise("QLD")
    c = table(spark, d, "customer").select("c_custkey", state.alias("state"), (1990 + (F.col("c_custkey") * 37) % 2000).alias("postcode"))
    return c.select("c_custkey", "state", geo.metro_of_postcode(F.col("state"), F.col("postcode")).alias("metro"))


CENTRES_SQL = ", ".join(str(r) for r in geo.ALL_CENTRES)


@query(f"""
WITH m(city, state, lat, lng) AS (VALUES {CENTRES_SQL}),
c AS (SELECT c_custkey, -38.5 + (c_custkey % 137) * 0.05 AS lat, 144.5 + (c_custkey % 211) * 0.04 AS lng FROM customer),
j AS (SELECT c_custkey, m.city, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(m.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(m.lat)) * pow(sin(radians(m.lng - c.lng) / 2), 2))) AS m FROM c, m),
b AS (SELECT c_custkey, arg_min(city, m) AS city, min(m) AS m FROM j GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN m <= 100000 THEN city END AS centre, CASE WHEN m <= 100000 THEN round(m / 1000, 3) END AS km FROM b
""")
def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (-38.5 + (F.col("c_custkey") % 137) * 0.05).alias("lat"), (144.5 + (F.col("c_custkey") % 211) * 0.04).alias("lng"))
    n = geo.nearest_centre(c, "lat", "lng", 100_000)
    return n.select("c_custkey", "centre", F.round(F.col("centre_metres") / 1000, 3).alias("km"))


@query("""
SELECT DISTINCT 'customer' AS source_type, o_custkey::VARCHAR AS source_id, 'ordered_in' AS relation, 'status' AS target_type, o_orderstatus AS target_id FROM orders
UNION ALL SELECT DISTINCT 'supplier', l_suppkey::VARCHAR, 'supplies', 'part', l_partkey::VARCHAR FROM lineitem
""")
def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.edges([
        (table(spark, d, "orders"), "customer", "o_custkey", "ordered_in", "status", "o_orderstatus"),
        (table(spark, d, "lineitem"), "supplier", "l_suppkey", "supplies", "part", "l_partkey"),
    ])


@query("""
SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS orders, (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS statuses FROM customer
""")
def company_with_relations(spark: SparkSession, d: str) -> DataFrame:
    c = R.with_related(table(spark, d, "customer"), "c_custkey", {"orders": (table(spark, d, "orders"), "o_custkey", "o_orderstatus")})
    return c.select("c_custkey", "c_name", F.col("orders_n").alias("orders"), F.col("orders_labels").alias("statuses"))
