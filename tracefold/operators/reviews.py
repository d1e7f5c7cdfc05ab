"""Reviews of where records are said to be, what a geocoder answers, and which records are due for another look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.dates import ROTATION_BLOCKS, half_day_block, rotation_bucket
from tracefold.functions.geo import ALL_CENTRES, CITY_CENTRES, distance_metres

# Distances, in metres unless they say kilometres.
SAME_POINT, AGREE_ADDRESS, AGREE_AREA, CENTRE, FAR_KM = 25, 500, 2500, 120, 100
QUALITY = ("region", "city", "suburb", "street", "house")


def _from_city(lat: Column, lng: Column, city: Column) -> Column:
    """Metres from the centre of the named city, null for a city that is not listed."""
    out = F.lit(None).cast("double")
    for name, _, y, x in CITY_CENTRES:
        out = F.when(F.lower(city) == name.lower(), distance_metres(lat, lng, F.lit(y), F.lit(x))).otherwise(out)
    return out


def _to_any_centre(lat: Column, lng: Column) -> Column:
    return F.least(*[distance_metres(lat, lng, F.lit(y), F.lit(x)) for _, _, y, x in ALL_CENTRES])


def location_issues(rows: DataFrame) -> DataFrame:
    """(id, issues): codes of what is wrong with, or only roughly known of, each location, in a fixed order.

    rows: id, precision, lat, lng, address, suburb, city, verified_at.
    """
    exact = F.col("precision").isin("EXACT", "SUBURB")
    point = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    # rows at one point share it innocently if they have one address, or one suburb at that precision
    place = F.when(F.col("precision") == "SUBURB", F.lower("suburb")).otherwise(F.lower("address"))
    at = rows.where(exact & point).groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce(place, F.concat(F.lit("?"), F.col("id").cast("string")))).alias("places"))
    j = rows.join(at, ["lat", "lng"], "left")
    far = _from_city(F.col("lat"), F.col("lng"), F.col("city")) > FAR_KM * 1000
    codes = [
        ("unknown_location", F.col("precision") == "UNKNOWN"),
        ("city_level_only", F.col("precision") == "CITY"),
        ("state_level_only", F.col("precision") == "STATE"),
        ("suburb_level_only", F.col("precision") == "SUBURB"),
        ("missing_coordinates", exact & ~point),
        ("address_not_geocoded", F.col("precision").isin("CITY", "STATE") & ~point & F.col("address").rlike(r"^\d")),
        ("coordinates_on_area_location", F.col("precision").isin("CITY", "STATE") & point),
        ("shared_coordinates", exact & point & (F.col("places") > 1)),
        ("city_centre_coordinates", exact & point & F.col("verified_at").isNull() & (_to_any_centre(F.col("lat"), F.col("lng")) <= CENTRE)),
        ("coordinates_conflict", exact & point & far),
    ]
    return j.select("id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in codes])).alias("issues"))


def geocode_decision(rows: DataFrame) -> DataFrame:
    """(id, action, away): what a geocoder's answer means for the point on file.

    rows: id, status, quality, wanted, kind ('address' or 'area'), found_lat, found_lng, lat, lng, city, verified_at. Skipped
    is what was not found, or not as closely as wanted; a point that only stands on a city's centre counts as none.
    """
    order = F.array(*map(F.lit, QUALITY))
    rough = F.array_position(order, F.col("quality")) < F.array_position(order, F.col("wanted"))
    pinned = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    away = F.round(distance_metres(F.col("lat"), F.col("lng"), F.col("found_lat"), F.col("found_lng")))
    stand_in = pinned & (away > SAME_POINT) & F.col("verified_at").isNull() & (_to_any_centre(F.col("lat"), F.col("lng")) <= CENTRE)
    held = pinned & ~stand_in
    limit = F.when(F.col("kind") == "address", AGREE_ADDRESS).otherwise(AGREE_AREA)
    far = F.coalesce(_from_city(F.col("found_lat"), F.col("found_lng"), F.col("city")) > FAR_KM * 1000, F.lit(False))
    action = (
        F.when((F.col("status") != "found") | rough, "skip")
        .when(~held & far, "conflict")
        .when(~held, "place")
        .when(away <= SAME_POINT, "agrees")
        .when((F.col("kind") != "address") & (away <= limit), "agrees")
        .when(away <= limit, "confirm")
        .otherwise("conflict")
    )
    return rows.select("id", action.alias("action"), F.when(action.isin("agrees", "confirm") | ((action == "conflict") & held), away).alias("away"))


def due_for_discovery(rows: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """(id, rank): records to look at: never seen first, then the longest unseen.

    rows: id, checked_at, covered, failing, hint_at. A covered record whose source works is left alone; a hint newer than the
    last look brings one forward; all others have their turn once in ROTATION_BLOCKS half days, if not seen for six hours.
    """
    turn = rotation_bucket(F.col("id").cast("string")) == half_day_block(as_of) % ROTATION_BLOCKS
    rested = F.col("checked_at") <= as_of - F.make_dt_interval(F.lit(0), F.lit(6))
    due = F.when(F.col("checked_at").isNull(), True).when(F.col("covered") & ~F.col("failing"), False).when(F.col("hint_at") > F.col("checked_at"), True).otherwise(turn & rested)
    head = rows.where(due).orderBy(F.col("checked_at").asc_nulls_first(), "id").limit(limit)
    return head.select("id", F.row_number().over(Window.orderBy(F.col("checked_at").asc_nulls_first(), "id")).alias("rank"))
