"""Reviews of locations and geocoder answers, rotation, labels, windows and headlines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import dates as D
from tracefold.functions import geo
from tracefold.functions import headlines as H
from tracefold.operators import reviews as R
from tracefold.plans.base import query
from tracefold.session import table

PLACES_SQL = """(SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'SUBURB' WHEN 2 THEN 'CITY' WHEN 3 THEN 'STATE' ELSE 'UNKNOWN' END AS p,
  CASE WHEN c_custkey % 7 <> 0 THEN -33.8688 + (c_custkey % 60) * 0.03 END AS lat, CASE WHEN c_custkey % 7 <> 0 THEN 151.2093 END AS lng,
  CASE WHEN c_acctbal > 0 THEN (c_custkey % 60)::VARCHAR || ' High St' END AS address, 'sub' || (c_custkey % 4)::VARCHAR AS suburb, c_acctbal > 3000 AS verified FROM customer)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    p = F.when(k % 5 == 0, "EXACT").when(k % 5 == 1, "SUBURB").when(k % 5 == 2, "CITY").when(k % 5 == 3, "STATE").otherwise("UNKNOWN")
    return table(spark, d, "customer").select(
        k.alias("id"), p.alias("precision"), F.when(k % 7 != 0, -33.8688 + (k % 60) * 0.03).alias("lat"), F.when(k % 7 != 0, 151.2093).alias("lng"),
        F.when(F.col("c_acctbal") > 0, F.concat((k % 60).cast("string"), F.lit(" High St"))).alias("address"), F.concat(F.lit("sub"), (k % 4).cast("string")).alias("suburb"),
        F.lit("Sydney").alias("city"), F.when(F.col("c_acctbal") > 3000, F.lit(datetime(2026, 1, 1))).alias("verified_at"),
    )


DISTANCE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({y} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({y})) * pow(sin(radians({x} - {b}) / 2), 2)))"
NEAREST_SQL = "least(" + ", ".join(DISTANCE.format(y=y, x=x, a="lat", b="lng") for _, _, y, x in geo.ALL_CENTRES) + ")"
SYDNEY_SQL = DISTANCE.format(y=-33.8688, x=151.2093, a="lat", b="lng")


@query(f"""
WITH e AS (SELECT *, p IN ('EXACT', 'SUBURB') AS ex, lat IS NOT NULL AS pt FROM {PLACES_SQL}),
g AS (SELECT lat, lng, count(DISTINCT coalesce(CASE WHEN p = 'SUBURB' THEN suburb ELSE lower(address) END, '?' || id::VARCHAR)) AS places FROM e WHERE ex AND pt GROUP BY ALL)
SELECT id, array_to_string(list_filter([CASE WHEN p = 'UNKNOWN' THEN 'unknown_location' END, CASE WHEN p = 'CITY' THEN 'city_level_only' END, CASE WHEN p = 'STATE' THEN 'state_level_only' END, CASE WHEN p = 'SUBURB' THEN 'suburb_level_only' END,
  CASE WHEN ex AND NOT pt THEN 'missing_coordinates' END, CASE WHEN p IN ('CITY', 'STATE') AND NOT pt AND regexp_matches(address, '^[0-9]') THEN 'address_not_geocoded' END, CASE WHEN p IN ('CITY', 'STATE') AND pt THEN 'coordinates_on_area_location' END,
  CASE WHEN ex AND pt AND places > 1 THEN 'shared_coordinates' END, CASE WHEN ex AND pt AND NOT verified AND {NEAREST_SQL} <= 120 THEN 'city_centre_coordinates' END, CASE WHEN ex AND pt AND {SYDNEY_SQL} > 100000 THEN 'coordinates_conflict' END], lambda x: x IS NOT NULL), ',') AS issues
FROM e LEFT JOIN g USING (lat, lng)
""")
def location_review(spark: SparkSession, d: str) -> DataFrame:
    return R.location_issues(places(spark, d)).select("id", F.array_join("issues", ",").alias("issues"))


@query(f"""
WITH e AS (SELECT *, lat + (id % 9) * 0.0004 AS fa, 151.2093 AS fb, id % 11 = 0 AS missing, id % 3 AS k FROM {PLACES_SQL}),
f AS (SELECT id, k, missing, verified, lat, lng, coalesce(fa, CASE WHEN id % 2 = 0 THEN -33.8 ELSE -31.9523 END) AS fa, CASE WHEN lat IS NULL AND id % 2 = 1 THEN 115.8613 ELSE fb END AS fb FROM e),
g AS (SELECT *, round({DISTANCE.format(y="fa", x="fb", a="lat", b="lng")}) AS away, {DISTANCE.format(y="-33.8688", x="151.2093", a="fa", b="fb")} > 100000 AS far, coalesce({NEAREST_SQL}, 1e9) <= 120 AS centre FROM f),
h AS (SELECT *, lat IS NOT NULL AND NOT (away > 25 AND NOT verified AND centre) AS held FROM g),
a AS (SELECT id, away, held, CASE WHEN missing OR k = 2 THEN 'skip' WHEN NOT held AND far THEN 'conflict' WHEN NOT held THEN 'place' WHEN away <= 25 THEN 'agrees' WHEN k = 1 AND away <= 2500 THEN 'agrees' WHEN k = 0 AND away <= 500 THEN 'confirm' ELSE 'conflict' END AS action FROM h)
SELECT id, action, CASE WHEN action IN ('agrees', 'confirm') OR (action = 'conflict' AND held) THEN away END AS away FROM a
""")
def geocode_decisions(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    k = F.col("id") % 3
    found_lat = F.coalesce(F.col("lat") + (F.col("id") % 9) * 0.0004, F.when(F.col("id") % 2 == 0, -33.8).otherwise(-31.9523))
    found_lng = F.when(F.col("lat").isNull() & (F.col("id") % 2 == 1), 115.8613).otherwise(151.2093)
    rows = p.withColumns(
        {
            "status": F.when(F.col("id") % 11 == 0, "none").otherwise("found"), "quality": F.when(k == 2, "city").otherwise("house"), "wanted": F.when(k == 1, "suburb").otherwise("street"),
            "kind": F.when(k == 1, "area").otherwise("address"), "found_lat": found_lat, "found_lng": found_lng,
        }
    )
    return R.geocode_decision(rows)


@query("""
WITH o AS (SELECT o_custkey AS id, max(o_orderdate) AS checked_at FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey AS id, c_acctbal > 8000 AS covered, c_acctbal > 9500 AS failing, checked_at FROM customer LEFT JOIN o ON id = c_custkey),
b AS (SELECT *, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) % 14 AS bucket FROM c),
u AS (SELECT * FROM b WHERE checked_at IS NULL OR (NOT (covered AND NOT failing) AND bucket = floor(epoch(TIMESTAMP '2001-08-02 07:00:00') / 43200)::BIGINT % 14 AND checked_at <= TIMESTAMP '2001-08-02 01:00:00'))
SELECT id, row_number() OVER (ORDER BY checked_at NULLS FIRST, id)::INTEGER AS rank FROM u ORDER BY rank LIMIT 50
""")
def discovery_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Customers due for a look, the longest unseen first; tests hold the buckets against FNV-1a in Python too."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("checked_at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 8000).alias("covered"), (F.col("c_acctbal") > 9500).alias("failing"))
    rows = c.join(last, "id", "left").withColumn("hint_at", F.lit(None).cast("timestamp"))
    return R.due_for_discovery(rows, F.lit(datetime(2001, 8, 2, 7)), 50)


@query("""
WITH a AS (SELECT o_orderkey, floor(greatest(epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate), 0) / 86400)::BIGINT AS n FROM orders)
SELECT o_orderkey, CASE WHEN n > 60 THEN 'Needs re-check' WHEN n = 0 THEN 'Verified today' WHEN n = 1 THEN 'Verified yesterday' WHEN n < 14 THEN 'Verified ' || n || ' days ago' ELSE 'Verified ' || (n // 7) || ' weeks ago' END AS label FROM a
""")
def verified_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.verified_label(F.col("o_orderdate"), F.lit(datetime(2001, 8, 1))).alias("label"))


@query("""
WITH l AS (SELECT event_id, ts + INTERVAL 11 HOUR AS t FROM events)
SELECT event_id, CASE WHEN hour(t) BETWEEN 8 AND 11 THEN strftime(t, '%Y-%m-%d') || ' AM' WHEN hour(t) >= 20 THEN strftime(t, '%Y-%m-%d') || ' PM' END AS slot FROM l
""")
def refresh_slots(spark: SparkSession, d: str) -> DataFrame:
    """The refresh window of each event; all lie in January, eleven hours behind the windows' zone."""
    return table(spark, d, "events").select("event_id", D.slot(F.col("ts")).alias("slot"))


@query("""
SELECT o_orderkey, 'Made' || o_orderkey AS company, CASE o_orderstatus WHEN 'F' THEN 'Series B+' WHEN 'O' THEN 'Seed' ELSE 'Pre-seed' END AS round, CASE WHEN o_orderkey % 2 = 0 THEN 'Perth' END AS city FROM orders
""")
def headline_facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    stage = F.when(F.col("o_orderstatus") == "F", "series  b+").when(F.col("o_orderstatus") == "O", "seed").otherwise("pre-seed")
    place = F.when(F.col("o_orderkey") % 2 == 0, "Perth-based ").otherwise("")
    title = F.concat(place, F.lit("fintech startup Made"), k, F.lit(" raises $5m in "), stage, F.lit(" funding"))
    rows = table(spark, d, "orders").select("o_orderkey", title.alias("t"))
    return rows.select("o_orderkey", H.company(F.col("t")).alias("company"), H.funding_round(F.col("t")).alias("round"), H.city_hint(F.col("t")).alias("city"))
