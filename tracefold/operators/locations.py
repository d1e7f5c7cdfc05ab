"""Where a company is said to be: its headquarters as a row, what a visitor is told, how sure it is, what backs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.records import known

# What a kind of source is worth for a location, and the points from which it counts as sure.
SOURCE_POINTS = {"company_website": 2.0, "company_document": 2.0, "credible_profile": 1.5, "manual": 1.5, "ecosystem_source": 0.5}
HIGH, MEDIUM = 3.5, 1.5
CLOCK_TOLERANCE = 600


def confidence(source: Column, verified: Column, geocoder_agrees: Column) -> Column:
    """high, medium or low; null without a source. High takes an official source, read, and a geocoder that agrees."""
    worth = F.lit(0.0)
    for kind, points in SOURCE_POINTS.items():
        worth = F.when(source == kind, points).otherwise(worth)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = worth + one(verified) + one(geocoder_agrees)
    return F.when(source.isNotNull(), F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low"))


def headquarters(companies: DataFrame) -> DataFrame:
    """A location row for each company, derived from its own fields and never edited.

    companies: id, precision, address, suburb, city, state, postcode, lat, lng. An address of unknown precision is not repeated.
    """
    precision = F.coalesce("precision", F.lit("UNKNOWN"))
    address = F.when((precision != "UNKNOWN") & (F.trim("address") != ""), F.col("address"))
    return companies.select(
        F.concat(F.col("id").cast("string"), F.lit(".hq")).alias("id"), F.col("id").alias("company_id"), F.lit("HEADQUARTERS").alias("kind"), address.alias("address"), "suburb",
        known(F.col("city")).alias("city"), "state", "postcode", F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), precision.alias("precision"),
    )


def described(rows: DataFrame) -> DataFrame:
    """`rows` with place, the line that says where a company is, and quality, how well that is known.

    rows: precision, street, suburb, city, state, verified_at; a street is shown only at an exact place.
    """
    city = known(F.col("city"))
    empty = lambda c: F.nullif(c, F.lit(""))
    where = F.concat_ws(", ", empty(city), empty(F.col("state")))
    suburb = F.when(~F.col("suburb").eqNullSafe(city), empty(F.col("suburb")))
    or_where = lambda line: F.when(line != "", line).otherwise(where)
    place = (
        F.when(F.col("precision") == "EXACT", or_where(F.concat_ws(", ", empty(F.col("street")), suburb, empty(city))))
        .when(F.col("precision") == "SUBURB", or_where(F.concat_ws(", ", empty(F.col("suburb")), F.when(~F.col("suburb").eqNullSafe(city), empty(city)))))
        .when(F.col("precision") == "CITY", where)
        .when(F.col("precision") == "STATE", F.col("state"))
    )
    office = F.when(F.col("verified_at").isNotNull(), "Verified office").otherwise("Office address on file")
    quality = F.when(F.col("precision") == "EXACT", office).when(F.col("precision") == "SUBURB", "Location: suburb-level").when(F.col("precision") == "CITY", "Exact location not published")
    return rows.withColumns({"place": place, "quality": quality.when(F.col("precision") == "STATE", "Location: state-level").otherwise("Location unknown")})


def backing(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(company_id, field, value, source_id, url): active claims about address and city with the source that they cite."""
    rows = claims.where("status = 'active' AND field IN ('address', 'city')")
    return rows.join(sources.select(F.col("id").alias("source_id"), "url"), "source_id").select("company_id", "field", "value", "source_id", "url")


def out_of_order(log: DataFrame) -> DataFrame:
    """Rows of a log that are more than CLOCK_TOLERANCE seconds earlier than the row before them.

    log: position (consecutive, as in an append-only log), at. Each row meets the one before it by position, so the log is
    never put in order in one task.
    """
    before = log.select((F.col("position") + 1).alias("position"), F.col("at").alias("at_before"))
    return log.join(before, "position").where(F.col("at") + F.make_dt_interval(secs=F.lit(CLOCK_TOLERANCE)) < F.col("at_before"))
