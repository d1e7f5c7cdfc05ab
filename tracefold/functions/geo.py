"""Distances, places and the metropolitan areas of postcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_METRES = 6371008.8

# Postcode ranges of the large cities.
METRO_RANGES = (
    ("NSW", 2000, 2234, "Sydney"), ("NSW", 2555, 2574, "Sydney"), ("NSW", 2745, 2770, "Sydney"), ("NSW", 2280, 2310, "Newcastle"),
    ("ACT", 2600, 2618, "Canberra"), ("ACT", 2900, 2920, "Canberra"), ("VIC", 3000, 3207, "Melbourne"), ("VIC", 3335, 3338, "Melbourne"),
    ("VIC", 3427, 3429, "Melbourne"), ("QLD", 4000, 4179, "Brisbane"), ("QLD", 4210, 4230, "Gold Coast"), ("SA", 5000, 5199, "Adelaide"),
    ("WA", 6000, 6199, "Perth"), ("TAS", 7000, 7109, "Hobart"), ("NT", 800, 832, "Darwin"),
)
# Centres of the larger cities.
CITY_CENTRES = (
    ("Sydney", "NSW", -33.8688, 151.2093), ("Melbourne", "VIC", -37.8136, 144.9631), ("Brisbane", "QLD", -27.4698, 153.0251),
    ("Perth", "WA", -31.9523, 115.8613), ("Adelaide", "SA", -34.9285, 138.6007), ("Hobart", "TAS", -42.8821, 147.3272),
    ("Darwin", "NT", -12.4634, 130.8456), ("Canberra", "ACT", -35.2809, 149.13), ("Newcastle", "NSW", -32.9283, 151.7817),
    ("Wollongong", "NSW", -34.4278, 150.8931), ("Gold Coast", "QLD", -28.0167, 153.4), ("Sunshine Coast", "QLD", -26.65, 153.0667),
    ("Geelong", "VIC", -38.1499, 144.3617), ("Townsville", "QLD", -19.259, 146.8169), ("Cairns", "QLD", -16.9186, 145.7781),
    ("Toowoomba", "QLD", -27.5598, 151.9507), ("Ballarat", "VIC", -37.5622, 143.8503), ("Bendigo", "VIC", -36.757, 144.2794),
    ("Launceston", "TAS", -41.4332, 147.1441), ("Noosa", "QLD", -26.3977, 153.09), ("Orange", "NSW", -33.2835, 149.1012),
    ("Wagga Wagga", "NSW", -35.1082, 147.3598), ("Albury", "NSW", -36.0737, 146.9135), ("Port Macquarie", "NSW", -31.4333, 152.9),
    ("Queanbeyan", "NSW", -35.353, 149.232),
)
# Further points that stand for the centre of a city.
OTHER_CENTRES = (("Sydney", "NSW", -33.86984, 151.20828), ("Canberra", "ACT", -35.29759, 149.10127), ("Newcastle", "NSW", -32.9193, 151.77953))
ALL_CENTRES = CITY_CENTRES + OTHER_CENTRES
# Rough boxes around the states, as south, north, west, east.
STATE_BOXES = {
    "NSW": (-37.55, -28.1, 140.95, 153.7), "VIC": (-39.2, -33.95, 140.9, 150.05), "QLD": (-29.2, -9.1, 137.95, 153.6), "SA": (-38.1, -25.95, 128.95, 141.05),
    "WA": (-35.2, -13.65, 112.85, 129.05), "TAS": (-43.75, -39.15, 143.7, 148.6), "NT": (-26.05, -10.9, 128.95, 138.05), "ACT": (-35.95, -35.1, 148.7, 149.45),
}


def states_at(lat: Column, lng: Column) -> Column:
    """array<string> of the states whose boxes hold a point; boxes overlap at borders."""
    return F.array_compact(F.array(*[F.when(lat.between(s, n) & lng.between(w, e), F.lit(state)) for state, (s, n, w, e) in STATE_BOXES.items()]))


def conflicts_with_state(lat: Column, lng: Column, state: Column) -> Column:
    """Whether a point lies in some state, but not in the one that is named. A point in none is no conflict of states."""
    at = states_at(lat, lng)
    return (F.size(at) > 0) & ~F.coalesce(F.array_contains(at, state), F.lit(False))


def distance_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(h))


def centres(spark: SparkSession) -> DataFrame:
    """The city centres: a table of fixed size, safe to broadcast."""
    return spark.createDataFrame(list(CITY_CENTRES), "city string, state string, lat double, lng double")


def metro_of_postcode(state: Column, postcode: Column) -> Column:
    """The large city whose ranges hold a postcode of its state, null for none."""
    code = postcode.try_cast("int")
    out = F.lit(None).cast("string")
    for s, low, high, metro in reversed(METRO_RANGES):
        out = F.when((state == s) & code.between(low, high), metro).otherwise(out)
    return out


def nearest_centre(points: DataFrame, lat: str, lng: str, within_metres: float) -> DataFrame:
    """`points` with the nearest centre within a distance, as centre and centre_metres; the centres are of fixed number.

    The distances are compared inside the row, so that no pair of point and centre becomes a row.
    """
    each = F.array(*[F.struct(distance_metres(F.col(lat), F.col(lng), F.lit(y), F.lit(x)).alias("m"), F.lit(c).alias("city")) for c, _, y, x in ALL_CENTRES])
    best = F.array_min(each)
    return points.withColumn("__best", best).withColumns(
        {"centre": F.when(F.col("__best.m") <= within_metres, F.col("__best.city")), "centre_metres": F.when(F.col("__best.m") <= within_metres, F.col("__best.m"))}
    ).drop("__best")


def location_block(verified: Column, address: Column, lat: Column, lng: Column, suburb: Column, city: Column, state: Column) -> Column:
    """How precisely a location is known."""
    point = lat.isNotNull() & lng.isNotNull()
    street = address.rlike(r"\d") & address.rlike("[A-Za-z]")
    return (
        F.when(~F.coalesce(verified, F.lit(False)), "UNKNOWN")
        .when(F.coalesce(street, F.lit(False)) & point, "EXACT")
        .when(suburb.isNotNull() & ~F.coalesce(F.lower(suburb) == F.lower(city), F.lit(False)) & point, "SUBURB")
        .when(city.isNotNull(), "CITY")
        .when(state.isNotNull(), "STATE")
        .otherwise("UNKNOWN")
    )
