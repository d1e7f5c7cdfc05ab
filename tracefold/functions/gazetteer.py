"""Places named in free text: the phrases of a listing meet a gazetteer by joins, the whole before its pieces before its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.geo import CITY_CENTRES
from tracefold.functions.names import fold

# Names of Australian states, and what listings write for places elsewhere: words, city, country, region.
STATE_NAMES = {
    "nsw": "NSW", "new south wales": "NSW", "vic": "VIC", "victoria": "VIC", "qld": "QLD", "queensland": "QLD", "sa": "SA", "south australia": "SA",
    "wa": "WA", "western australia": "WA", "tas": "TAS", "tasmania": "TAS", "nt": "NT", "northern territory": "NT", "act": "ACT", "australian capital territory": "ACT",
}
ELSEWHERE = (
    (("sf", "san francisco", "bay area", "san francisco bay area", "palo alto", "menlo park"), "San Francisco", "United States", None),
    (("nyc", "new york", "new york city"), "New York", "United States", None),
    (("la", "los angeles"), "Los Angeles", "United States", None),
    (("boston",), "Boston", "United States", None),
    (("austin",), "Austin", "United States", None),
    (("seattle",), "Seattle", "United States", None),
    (("us", "usa", "united states", "united states of america"), None, "United States", None),
    (("london",), "London", "United Kingdom", None),
    (("uk", "united kingdom", "england", "britain", "great britain"), None, "United Kingdom", None),
    (("canada", "toronto", "vancouver"), None, "Canada", None),
    (("india", "bengaluru", "bangalore", "mumbai", "delhi", "new delhi"), None, "India", None),
    (("singapore",), "Singapore", "Singapore", None),
    (("new zealand", "nz", "auckland", "wellington"), None, "New Zealand", None),
    (("sea", "southeast asia", "south east asia"), None, None, "Southeast Asia"),
    (("europe",), None, None, "Europe"),
)
HOME = "Australia"


def gazetteer(spark: SparkSession) -> DataFrame:
    """(phrase, kind, city, state, country, region): of fixed size, some hundred rows."""
    rows = [(HOME.lower(), "home", None, None, HOME, None)]
    rows += [(k, "state", None, v, HOME, None) for k, v in STATE_NAMES.items()]
    rows += [(city.lower(), "city", city, state, HOME, None) for city, state, *_ in CITY_CENTRES]
    rows += [(w, "elsewhere", city, None, country, region) for words, city, country, region in ELSEWHERE for w in words]
    return spark.createDataFrame(rows, "phrase string, kind string, city string, state string, country string, region string")


def plain(text: Column) -> Column:
    """Lower-cased words of letters and digits. Accents must be folded already."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), r"\s+", " "))


def places_named(listings: DataFrame, id_col: str, text_col: str, known: DataFrame, folded: bool = False) -> DataFrame:
    """(id, label, city, state, country, region, scope) of each listing, `known` being a gazetteer.

    Phrases count in the order whole, pieces between commas, slashes and dots, single words, pairs of words. A state of three
    letters or fewer counts only beside other words. A listing is Australian (scope au) if it says so, names a state, or names
    a city with nothing beside it but Australian words; else the first phrase before its single words that names a place
    elsewhere stands, and what names none is global. Ids must be unique; null and blank texts have no label.
    """
    text = F.col(text_col) if folded else fold(F.col(text_col))
    t = listings.select(F.col(id_col).alias("id"), F.when(F.trim(text_col) != "", F.trim(text_col)).alias("label"), text.alias("__t"))
    pieces = F.filter(F.transform(F.split("__t", "[,/·|]"), plain), lambda p: p != "")
    t = t.withColumns({"pieces": pieces, "whole": plain(F.col("__t"))})
    t = t.withColumn("words", F.split("whole", " "))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get(F.col("words"), i - 1), F.get(F.col("words"), i)))
    grams = F.concat("words", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("many", (F.size("pieces") > 1) | (F.size("words") > 1))
    said = F.concat(F.array(F.struct(F.lit(0).alias("level"), F.col("whole").alias("phrase"))), F.transform("pieces", lambda p: F.struct(F.lit(1).alias("level"), p.alias("phrase"))), F.transform(grams, lambda g: F.struct(F.lit(2).alias("level"), g.alias("phrase"))))
    each = t.where("label IS NOT NULL").select("id", "many", F.posexplode(said).alias("at", "s")).select("id", "many", "at", "s.*")
    hit = each.join(F.broadcast(known), "phrase")
    hit = hit.where((F.col("kind") != "state") | (F.length("phrase") > 3) | F.col("many"))
    first = lambda c, on, at="at": F.min_by(F.when(on, F.col(c)), F.when(on, F.col(at)))
    is_city, is_state = F.col("kind") == "city", F.col("kind") == "state"
    per = hit.groupBy("id").agg(
        F.max(F.col("kind") == "home").alias("home"), first("state", is_state).alias("own_state"), first("city", is_city).alias("city"), first("state", is_city).alias("city_state"),
        F.count_if((F.col("level") == 1) & (F.col("country") == HOME)).alias("home_pieces"),
        F.min_by(F.when((F.col("kind") == "elsewhere") & (F.col("level") < 2), F.struct("city", "country", "region")), F.when((F.col("kind") == "elsewhere") & (F.col("level") < 2), F.col("at"))).alias("there"),
    )
    j = t.join(per, "id", "left")
    only_home = (F.size("pieces") == F.coalesce("home_pieces", F.lit(0))) | (F.size("pieces") == 1)
    au = F.coalesce(F.col("home"), F.lit(False)) | F.col("own_state").isNotNull() | (F.col("city").isNotNull() & only_home)
    return j.select(
        "id", "label", F.when(au, F.col("city")).otherwise(F.col("there.city")).alias("city"), F.when(au, F.coalesce("own_state", "city_state")).alias("state"),
        F.when(au, HOME).otherwise(F.col("there.country")).alias("country"), F.when(~au, F.col("there.region")).alias("region"), F.when(au, "au").otherwise("global").alias("scope"),
    )
