"""Claims with provenance: which source says what about which record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import addresses
from tracefold.functions.once import once
from tracefold.functions.urls import url_key

RANK = {"high": 3, "medium": 2, "low": 1}
RELIABILITY = {"high": 1.0, "medium": 0.7, "low": 0.4}
UNSOURCED, CONFLICTED = 0.25, 0.2

# The fields that a source can make a claim about, with cardinality and type.
FIELDS = (
    ("website", "single", "url"), ("sector", "single", "string"), ("subsector", "single", "string"), ("city", "single", "string"),
    ("state", "single", "state"), ("address", "single", "string"), ("stage", "single", "string"), ("company_status", "single", "enum"),
    ("hiring_status", "single", "enum"), ("employee_range", "single", "enum"), ("founded_year", "single", "year"),
    ("funding_total", "single", "money"), ("last_funding_round", "single", "string"), ("last_funding_date", "single", "date"),
    ("remote_policy", "single", "enum"), ("tech_stack", "multi", "string"), ("cohorts", "multi", "enum"), ("team_size", "single", "count"),
    ("last_role_seen_at", "single", "timestamp"), ("description", "text", "string"), ("founders", "multi", "string"), ("investors", "multi", "string"),
)


def registry(spark: SparkSession) -> DataFrame:
    """(field, cardinality, type, field_order): of fixed size, safe to broadcast."""
    return spark.createDataFrame([(*f, i) for i, f in enumerate(FIELDS)], "field string, cardinality string, type string, field_order int")


@dataclass(frozen=True)
class Claims:
    """The columns of a table of claims."""

    subject: str = "company_id"
    field: str = "field"
    value: str = "value"
    confidence: str = "confidence"


def rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def label(r: Column) -> Column:
    return F.when(r == 3, "high").when(r == 2, "medium").otherwise("low")


def text_key(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(v), r"\s+", " "))


def value_key(field_type: Column, name: Column, v: Column) -> Column:
    """A text under which equal values of a field meet, for the types whose equality has one.

    Addresses and money have none (an amount without a currency equals any): see `grouped_values`.
    """
    return (
        F.when(field_type == "url", url_key(v))
        .when(field_type == "year", v.try_cast("int").cast("string"))
        .when(field_type == "state", F.upper(v))
        .when(name == "city", text_key(F.regexp_replace(v, r"\s*\([^)]*\)", "")))
        .otherwise(text_key(v))
    )


def flatten(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Each claim with what is known of its source."""
    s = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_name"), F.col("url").alias("source_url"), F.col("kind").alias("source_type"), "retrieved_at")
    return claims.withColumnRenamed("id", "evidence_id").join(s, "source_id", "left")


def distinct_values(claims: DataFrame, c: Claims, key: str) -> DataFrame:
    """(subject, field, key, rows, best): the different values that a subject's sources state."""
    return claims.groupBy(c.subject, c.field, key).agg(F.count(F.lit(1)).alias("rows"), F.max(rank(F.col(c.confidence))).alias("best"))


def money(amount: Column, currency: Column) -> Column:
    """A sum as `same_money` compares it."""
    return F.struct(amount.cast("double").alias("amount"), currency.cast("string").alias("currency"))


def same_money(a: Column, b: Column) -> Column:
    """Equal amounts, and equal currencies where both state one."""
    return (a["amount"] == b["amount"]) & F.coalesce(a["currency"] == b["currency"], F.lit(True))


def place(address: Column) -> Column:
    """An address as `same_place` compares it."""
    return F.struct(address.alias("address"), addresses.street(address).alias("street"), addresses.postcode(address).alias("postcode"), addresses.normal(address).alias("normal"))


def same_place(a: Column, b: Column) -> Column:
    """Streets and postcodes where both state them, else the postcode where one has no street, else the whole text."""
    streets = a["street"].isNotNull() & b["street"].isNotNull()
    codes = F.coalesce(a["postcode"] == b["postcode"], F.lit(False))
    either = a["postcode"].isNull() | b["postcode"].isNull()
    return F.when(streets, (a["street"] == b["street"]) & (either | codes)).otherwise(codes | (a["normal"] == b["normal"]))


def grouped_values(claims: DataFrame, c: Claims, order: str, value: Column, equal) -> DataFrame:
    """(subject, field, value, rows, best): the different values of a subject where equality has no key, such as `same_money`.

    Values are taken in `order`; each joins the first earlier value that it equals, so a value without a currency joins the
    first of its amount. Repeats of one value are counted before a subject's values meet, so what meets is no more than the
    different values that its sources state.
    """
    rows = claims.withColumn("__value", value).where(F.col("__value").isNotNull())
    each = rows.groupBy(c.subject, c.field, "__value").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("rows"), F.max(rank(F.col(c.confidence))).alias("best"))
    one = F.struct("at", F.col("__value").alias("value"), "rows", "best")
    grouped = each.groupBy(c.subject, c.field).agg(F.sort_array(F.collect_list(one)).alias("__all"))
    kind = grouped.schema["__all"].dataType.simpleString()

    def join(found: Column, v: Column) -> Column:
        at = F.array_position(F.transform(found, lambda g: equal(g["value"], v["value"])), True)
        more = lambda g: F.struct(g["at"].alias("at"), g["value"].alias("value"), (g["rows"] + v["rows"]).alias("rows"), F.greatest(g["best"], v["best"]).alias("best"))
        return once(at, lambda hit: F.when(hit == 0, F.concat(found, F.array(v))).otherwise(F.transform(found, lambda g, i: F.when(i + 1 == hit, more(g)).otherwise(g))))

    done = F.aggregate("__all", F.array().cast(kind), join)
    return grouped.select(c.subject, c.field, F.inline(done)).drop("at")


def conflicts(claims: DataFrame, stored: DataFrame, c: Claims, key: str) -> DataFrame:
    """(subject, field, kind): sources that disagree, or one value on which they agree and the record has another.

    stored: (subject, field, stored_key).
    """
    per = claims.groupBy(c.subject, c.field).agg(F.countDistinct(key).alias("n"), F.min(key).alias("only"))
    both = per.join(stored, [c.subject, c.field], "left")
    kind = F.when(F.col("n") > 1, "sources_disagree").when(F.col("stored_key").isNotNull() & (F.col("stored_key") != F.col("only")), "stored_differs")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(c.subject, c.field, "kind", F.col("n").alias("values"))


def unapplied(claims: DataFrame, stored: DataFrame, c: Claims, key: str) -> DataFrame:
    """Single-valued fields on which the sources agree and the record says nothing."""
    per = claims.groupBy(c.subject, c.field).agg(F.countDistinct(key).alias("n"), F.min(key).alias("value_key"), F.max(rank(F.col(c.confidence))).alias("best"))
    return per.where("n = 1").join(stored.where("stored_key IS NOT NULL"), [c.subject, c.field], "left_anti").select(c.subject, c.field, "value_key", label(F.col("best")).alias("best_confidence"))


def weak(claims: DataFrame, stored: DataFrame, c: Claims, key: str) -> DataFrame:
    """Stored values that only claims of low confidence support."""
    support = claims.join(stored.where("stored_key IS NOT NULL"), [c.subject, c.field]).where(F.col(key) == F.col("stored_key"))
    return support.groupBy(c.subject, c.field).agg(F.max(rank(F.col(c.confidence))).alias("best"), F.count(F.lit(1)).alias("rows")).where("best = 1").drop("best")


#: Types whose equality has no key.
MONEY, PLACE = "money", "place"


def judged(claims: DataFrame, stored: DataFrame, c: Claims, order: str) -> DataFrame:
    """(subject, field, values, rows, best, stated, agrees): what the sources of each field come to, equality by the field's type.

    claims: subject, field, type, value (text), amount and currency (for money), confidence and `order`, the place of a claim.
    stored: subject, field, stored_value, stored_amount, stored_currency. values: how many different ones are claimed; agrees:
    where they are one, whether the record says the same. An amount without a currency equals any of its size, an address one
    of its street and postcode.
    """
    s = stored.select(c.subject, c.field, "stored_value", "stored_amount", "stored_currency")
    keyed = claims.where(~F.col("type").isin(MONEY, PLACE)).withColumn("__key", value_key(F.col("type"), F.col(c.field), F.col(c.value)))
    types = keyed.select(c.subject, c.field, "type").groupBy(c.subject, c.field).agg(F.min("type").alias("type"))
    by_key = distinct_values(keyed.where("__key IS NOT NULL"), c, "__key")
    by_key = _counted(by_key.withColumnRenamed("__key", "value"), c).join(types, [c.subject, c.field]).join(s, [c.subject, c.field], "left")
    of_key = by_key.withColumn("agrees", F.col("first") == value_key(F.col("type"), F.col(c.field), F.col("stored_value"))).withColumn("stated", F.col("stored_value").isNotNull())
    sums = grouped_values(claims.where((F.col("type") == MONEY) & F.col("amount").isNotNull()), c, order, money(F.col("amount"), F.col("currency")), same_money)
    of_sums = _counted(sums, c).join(s, [c.subject, c.field], "left")
    of_sums = of_sums.withColumn("agrees", same_money(F.col("first"), money(F.col("stored_amount"), F.col("stored_currency")))).withColumn("stated", F.col("stored_amount").isNotNull())
    places = grouped_values(claims.where((F.col("type") == PLACE) & F.col(c.value).isNotNull()), c, order, place(F.col(c.value)), same_place)
    of_places = _counted(places, c).join(s, [c.subject, c.field], "left")
    of_places = of_places.withColumn("agrees", once(place(F.col("stored_value")), lambda p: same_place(F.col("first"), p))).withColumn("stated", F.col("stored_value").isNotNull())
    columns = [c.subject, c.field, "values", "rows", "best", "stated", "agrees"]
    return of_key.select(columns).unionByName(of_sums.select(columns)).unionByName(of_places.select(columns))


def _counted(values: DataFrame, c: Claims) -> DataFrame:
    """(subject, field, values, rows, best, first) of the different values of each field."""
    return values.groupBy(c.subject, c.field).agg(F.count(F.lit(1)).alias("values"), F.sum("rows").alias("rows"), F.max("best").alias("best"), F.first("value").alias("first"))


def typed_conflicts(claims: DataFrame, stored: DataFrame, c: Claims, order: str) -> DataFrame:
    """(subject, field, kind, values): like `conflicts`, with money and places compared as such."""
    kind = F.when(F.col("values") > 1, "sources_disagree").when(F.col("stated") & ~F.coalesce("agrees", F.lit(False)), "stored_differs")
    return judged(claims, stored, c, order).withColumn("kind", kind).where("kind IS NOT NULL").select(c.subject, c.field, "kind", "values")


def typed_unapplied(claims: DataFrame, stored: DataFrame, c: Claims, order: str) -> DataFrame:
    """(subject, field, best_confidence): like `unapplied`, with money and places compared as such."""
    return judged(claims, stored, c, order).where("values = 1 AND NOT stated").select(c.subject, c.field, label(F.col("best")).alias("best_confidence"))


def says_the_same(c: Claims) -> Column:
    """Whether a claim says what the record says, by the type of its field."""
    by_sum = same_money(money(F.col("amount"), F.col("currency")), money(F.col("stored_amount"), F.col("stored_currency")))
    by_place = once(F.struct(place(F.col(c.value)).alias("claim"), place(F.col("stored_value")).alias("record")), lambda p: same_place(p["claim"], p["record"]))
    by_key = value_key(F.col("type"), F.col(c.field), F.col(c.value)) == value_key(F.col("type"), F.col(c.field), F.col("stored_value"))
    return F.when(F.col("type") == MONEY, by_sum).when(F.col("type") == PLACE, by_place).otherwise(by_key)


def typed_confidence(claims: DataFrame, stored: DataFrame, c: Claims, weights: dict[str, float]) -> DataFrame:
    """(subject, score, label): like `confidence`, with money and places compared as such."""
    mine = stored.where(F.coalesce(F.col("stored_value"), F.col("stored_amount").cast("string")).isNotNull() & F.col(c.field).isin(*weights))
    j = mine.join(claims.select(c.subject, c.field, "type", c.value, "amount", "currency", c.confidence), [c.subject, c.field], "left")
    j = j.withColumn("stored_key", F.lit("same")).withColumn("__same", F.when(F.col("type").isNotNull(), F.when(F.coalesce(says_the_same(c), F.lit(False)), "same").otherwise("other")))
    return _weighted(j, c, "__same", weights)


def coverage(claims: DataFrame, c: Claims) -> DataFrame:
    """Claims and subjects of each field."""
    return claims.groupBy(c.field).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(c.subject).alias("subjects"))


def reliability(support: Column, differing: Column, best: Column) -> Column:
    """What a stored value is worth: by its best support, at most CONFLICTED where a claim differs."""
    own = F.when(support > 0, F.when(best == 3, RELIABILITY["high"]).when(best == 2, RELIABILITY["medium"]).otherwise(RELIABILITY["low"])).otherwise(UNSOURCED)
    return F.when(differing > 0, F.least(own, F.lit(CONFLICTED))).otherwise(own)


def confidence(claims: DataFrame, stored: DataFrame, c: Claims, key: str, weights: dict[str, float]) -> DataFrame:
    """(subject, score, label): the weighted mean of the reliability of all stored fields."""
    mine = stored.where(F.col("stored_key").isNotNull() & F.col(c.field).isin(*weights))
    return _weighted(mine.join(claims.select(c.subject, c.field, key, c.confidence), [c.subject, c.field], "left"), c, key, weights)


def _weighted(j: DataFrame, c: Claims, key: str, weights: dict[str, float]) -> DataFrame:
    same = F.col(key) == F.col("stored_key")
    per = j.groupBy(c.subject, c.field).agg(F.count_if(same).alias("support"), F.count_if(~same).alias("differing"), F.max(F.when(same, rank(F.col(c.confidence)))).alias("best"))
    weight = F.lit(1.0)
    for k, w in weights.items():
        weight = F.when(F.col(c.field) == k, float(w)).otherwise(weight)
    scored = per.withColumn("w", weight).withColumn("r", reliability(F.col("support"), F.col("differing"), F.col("best")))
    out = scored.groupBy(c.subject).agg(F.round(F.sum(F.col("r") * F.col("w")) / F.sum("w"), 2).alias("score"))
    return out.withColumn("label", confidence_label(F.col("score")))


def confidence_label(score: Column) -> Column:
    return F.when(score.isNull(), "not assessed").when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def newest(claims: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each group; rows without a time come last."""
    w = Window.partitionBy(*by).orderBy(F.col(at).desc_nulls_last(), F.col(tie))
    return claims.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def provenance(claims: DataFrame, roles: DataFrame, sources: DataFrame, public_kinds: list[str]) -> DataFrame:
    """(company_id, sources, checked_at): the public pages behind a company's claims and open roles, newest check first."""
    pages = sources.where(F.col("kind").isin(*public_kinds) & F.col("url").rlike(r"^https?://\S+$")).select(F.col("id").alias("source_id"), "url", "title")
    used = claims.where("status = 'active'").select("company_id", "source_id", F.col("verified_at").alias("at")).unionByName(
        roles.where("status = 'open'").select("company_id", "source_id", F.col("last_confirmed_at").alias("at"))
    )
    per = used.join(pages, "source_id").groupBy("company_id", "source_id", "url", "title").agg(F.max("at").alias("checked_at"))
    return per.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("checked_at", "url", "title")), asc=False).alias("sources"), F.max("checked_at").alias("checked_at"))


def backed_members(rows: DataFrame, claims: DataFrame, subject: str, members: str) -> DataFrame:
    """`rows` with only those members of a list that a claim states."""
    stated = claims.groupBy(subject).agg(F.collect_set(text_key(F.col("value"))).alias("__stated"))
    kept = F.filter(members, lambda m: F.array_contains("__stated", text_key(m)))
    return rows.join(stated, subject, "left").withColumn(members, F.when(F.size(kept) > 0, kept)).drop("__stated")


def evidence_ids(claims: DataFrame, parts: list[str]) -> DataFrame:
    """Claims with an id of their parts; repeats of one get .2, .3 and so on, in order of their place."""
    base = F.concat_ws(".", *parts)
    n = F.row_number().over(Window.partitionBy("__base").orderBy("_pos"))
    return claims.withColumn("__base", base).withColumn("__n", n).withColumn("id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws(".", "__base", "__n"))).drop("__base", "__n")
