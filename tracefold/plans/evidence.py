"""Claims and their agreement; line items stand for claims about orders, suppliers and parts for their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import evidence as E
from tracefold.plans.base import query
from tracefold.session import table

#: A line says what an order's status is (its line status), and how it went (its return flag), with a confidence by quantity.
CLAIMS_SQL = """(
  SELECT l_orderkey AS company_id, 'status' AS field, upper(l_linestatus) AS k, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 15 THEN 2 ELSE 1 END AS r, l_shipdate AS "at", l_linenumber AS line, l_suppkey AS source FROM lineitem
  UNION ALL SELECT l_orderkey, 'outcome', lower(l_returnflag), CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 15 THEN 2 ELSE 1 END, l_shipdate, l_linenumber, l_suppkey FROM lineitem WHERE l_tax < 0.04)"""
STORED_SQL = """(SELECT o_orderkey AS company_id, 'status' AS field, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS stored_key FROM orders)"""
COLUMNS = E.Claims()


def claims(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    confidence = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 15, "medium").otherwise("low")
    each = F.array_compact(
        F.array(
            F.struct(F.lit("status").alias("field"), F.col("l_linestatus").alias("value"), F.lit("state").alias("type")),
            F.when(F.col("l_tax") < 0.04, F.struct(F.lit("outcome").alias("field"), F.col("l_returnflag").alias("value"), F.lit("string").alias("type"))),
        )
    )
    rows = li.select(F.col("l_orderkey").alias("company_id"), confidence.alias("confidence"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source"), F.explode(each).alias("c"))
    rows = rows.select("company_id", "confidence", "at", "line", "source", "c.field", "c.value", "c.type")
    return rows.withColumn("k", E.value_key(F.col("type"), F.col("field"), F.col("value")))


def stored(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("company_id"), F.lit("status").alias("field"), F.when(F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus")).alias("stored_key"))


@query(f"SELECT company_id, field, k, count(*)::BIGINT AS rows, max(r)::INTEGER AS best FROM {CLAIMS_SQL} GROUP BY ALL")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return E.distinct_values(claims(spark, d), COLUMNS, "k")


@query(f"""
WITH p AS (SELECT company_id, field, count(DISTINCT k) AS n, min(k) AS one FROM {CLAIMS_SQL} GROUP BY ALL)
SELECT p.company_id, p.field, CASE WHEN n > 1 THEN 'sources_disagree' ELSE 'stored_differs' END AS kind, n::BIGINT AS "values"
FROM p LEFT JOIN {STORED_SQL} s USING (company_id, field) WHERE n > 1 OR (stored_key IS NOT NULL AND stored_key <> one)
""")
def conflict_values(spark: SparkSession, d: str) -> DataFrame:
    return E.conflicts(claims(spark, d), stored(spark, d), COLUMNS, "k")


@query(f"""
WITH p AS (SELECT company_id, field, count(DISTINCT k) AS n, min(k) AS value_key, max(r) AS best FROM {CLAIMS_SQL} GROUP BY ALL)
SELECT company_id, field, value_key, CASE best WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS best_confidence FROM p
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM {STORED_SQL} s WHERE s.company_id = p.company_id AND s.field = p.field AND stored_key IS NOT NULL)
""")
def unapplied_claims(spark: SparkSession, d: str) -> DataFrame:
    return E.unapplied(claims(spark, d), stored(spark, d), COLUMNS, "k")


@query(f"""
SELECT c.company_id, c.field, count(*)::BIGINT AS rows FROM {CLAIMS_SQL} c JOIN {STORED_SQL} s ON c.company_id = s.company_id AND c.field = s.field AND c.k = s.stored_key
GROUP BY ALL HAVING max(r) = 1
""")
def weak_claims(spark: SparkSession, d: str) -> DataFrame:
    return E.weak(claims(spark, d), stored(spark, d), COLUMNS, "k")


@query(f"SELECT field, count(*)::BIGINT AS rows, count(DISTINCT company_id)::BIGINT AS subjects FROM {CLAIMS_SQL} GROUP BY field")
def coverage_by_field(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage(claims(spark, d), COLUMNS)


@query(f"SELECT company_id, CASE max(r) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS best_confidence FROM {CLAIMS_SQL} GROUP BY company_id")
def best_confidence(spark: SparkSession, d: str) -> DataFrame:
    return claims(spark, d).groupBy("company_id").agg(E.label(F.max(E.rank(F.col("confidence")))).alias("best_confidence"))


@query(f"""
WITH o AS (SELECT company_id, field, stored_key FROM {STORED_SQL} WHERE stored_key IS NOT NULL
  UNION ALL SELECT o_orderkey, 'outcome', CASE WHEN o_totalprice > 250000 THEN 'n' ELSE 'a' END FROM orders),
j AS (SELECT o.company_id, o.field, count(*) FILTER (WHERE k = stored_key) AS same, count(*) FILTER (WHERE k <> stored_key) AS other, max(r) FILTER (WHERE k = stored_key) AS best
  FROM o LEFT JOIN {CLAIMS_SQL} c ON o.company_id = c.company_id AND o.field = c.field GROUP BY ALL),
v AS (SELECT *, CASE WHEN same > 0 THEN CASE best WHEN 3 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END ELSE 0.25 END::DOUBLE AS own FROM j),
w AS (SELECT company_id, CASE WHEN other > 0 THEN least(own, 0.2) ELSE own END AS rel, CASE field WHEN 'status' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM v),
s AS (SELECT company_id, round(sum(rel * w) / sum(w), 2) AS score FROM w GROUP BY company_id)
SELECT company_id, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM s
""")
def weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    outcome = o.select(F.col("o_orderkey").alias("company_id"), F.lit("outcome").alias("field"), F.when(F.col("o_totalprice") > 250000, "n").otherwise("a").alias("stored_key"))
    return E.confidence(claims(spark, d), stored(spark, d).unionByName(outcome), COLUMNS, "k", {"status": 2, "outcome": 1})


@query(f"""
SELECT company_id, field, k, "at" FROM (SELECT *, row_number() OVER (PARTITION BY company_id, field ORDER BY "at" DESC NULLS LAST, line, source) AS n FROM {CLAIMS_SQL}) WHERE n = 1
""")
def newest_claim(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).withColumn("tie", F.struct("line", "source"))
    return E.newest(rows, ["company_id", "field"], "at", "tie").select("company_id", "field", "k", "at")


@query("""
SELECT l_orderkey AS company_id, l_linenumber AS evidence_line, s_name AS source_name, s_acctbal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey
""")
def flatten_claims(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    sources = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("https://x.example/").alias("url"), F.lit("press").alias("kind"), F.col("s_acctbal").alias("retrieved_at"))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("company_id"), F.col("l_suppkey").alias("source_id"))
    return E.flatten(rows, sources).select("company_id", F.col("evidence_id").alias("evidence_line"), "source_name", F.col("retrieved_at").alias("s_acctbal"))


@query("""
WITH c AS (
  SELECT l_orderkey AS company_id, (l_quantity::BIGINT % 5)::DOUBLE AS amount, CASE l_linenumber % 3 WHEN 1 THEN 'AUD' WHEN 2 THEN 'USD' END AS currency, l_linenumber AS pos,
         CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END AS best FROM lineitem),
f AS (SELECT *, first_value(currency) OVER (PARTITION BY company_id, amount ORDER BY pos) AS first FROM c)
SELECT company_id, amount, CASE WHEN first IS NOT NULL THEN coalesce(currency, first) END AS currency, count(*)::BIGINT AS rows, max(best)::INTEGER AS best FROM f GROUP BY ALL
""")
def money_values(spark: SparkSession, d: str) -> DataFrame:
    """The different sums that the line items of an order state, some of them without a currency."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    currency = F.when(n % 3 == 1, "AUD").when(n % 3 == 2, "USD")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("company_id"), F.lit("funding_total").alias("field"), F.when(flag == "A", "high").when(flag == "R", "medium").otherwise("low").alias("confidence"),
        E.money(F.col("l_quantity").cast("long") % 5, currency).alias("sum"), n.alias("pos"),
    )
    found = E.grouped_values(rows, E.Claims(), "pos", F.col("sum"), E.same_money)
    return found.select("company_id", F.col("value.amount").alias("amount"), F.col("value.currency").alias("currency"), "rows", "best")


@query("""
WITH r AS (SELECT l_orderkey AS company_id, l_suppkey, l_shipdate::TIMESTAMP AS seen FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL SELECT o_orderkey, 1 + o_custkey % 7, o_orderdate::TIMESTAMP FROM orders WHERE o_orderstatus = 'O'),
u AS (SELECT company_id, l_suppkey, max(seen) AS checked FROM r GROUP BY ALL),
p AS (SELECT u.*, s_name FROM u JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 1000)
SELECT company_id, max(checked) AS checked_at, string_agg(s_name, ',' ORDER BY checked DESC, s_name DESC) AS sources FROM p GROUP BY company_id
""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Pages behind the claims (line items that were not returned) and the open roles (open orders) of each order."""
    id_of = lambda c: c.cast("string").alias("source_id")
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("company_id"), id_of(F.col("l_suppkey")), F.col("l_shipdate").cast("timestamp").alias("verified_at"), F.lit("active").alias("status"))
    o = table(spark, d, "orders")
    roles = o.select(F.col("o_orderkey").alias("company_id"), id_of(1 + F.col("o_custkey") % 7), F.col("o_orderdate").cast("timestamp").alias("last_confirmed_at"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    s = table(spark, d, "supplier")
    sources = s.select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_acctbal") > 1000, "press").otherwise("private").alias("kind"), F.concat(F.lit("https://x.example/"), "s_name").alias("url"), F.col("s_name").alias("title"))
    p = E.provenance(rows, roles, sources, ["press"])
    return p.select("company_id", "checked_at", F.array_join(F.transform("sources", lambda x: x["title"]), ",").alias("sources"))


#: The lines of an order as claims of its status, a sum of money, and a place.
TYPED_SQL = """
c AS (SELECT l_orderkey AS company_id, l_linenumber AS pos, l_linestatus AS st, (l_quantity::BIGINT % 2)::DOUBLE AS amount, CASE l_linenumber % 3 WHEN 1 THEN 'AUD' WHEN 2 THEN 'USD' END AS currency,
  l_suppkey % 4 AS p, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 15 THEN 2 ELSE 1 END AS r FROM lineitem),
m AS (SELECT *, first_value(currency) OVER (PARTITION BY company_id, amount ORDER BY pos, currency NULLS FIRST) AS fc FROM c),
q AS (SELECT company_id, CASE WHEN arg_min(p, (pos, [0, 3, 1, 2][p + 1])) = 3 THEN 1 ELSE count(DISTINCT CASE p WHEN 2 THEN 9 WHEN 3 THEN NULL ELSE 1 END) END AS n FROM c GROUP BY company_id)"""


def typed_claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    confidence = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 15, "medium").otherwise("low")
    said = F.element_at(F.array(*map(F.lit, ("1 High St, Perth WA 6000", "Unit 2, 1 High Street, Perth 6000", "9 Low Rd, Perth WA 6000", "Perth WA 6000"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    none, line = F.lit(None).cast("string"), F.col("l_linenumber")
    currency = F.when(line % 3 == 1, "AUD").when(line % 3 == 2, "USD")
    cell = lambda field, kind, value, amount, unit: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("type"), value.alias("value"), amount.alias("amount"), unit.alias("currency"))
    no_sum = F.lit(None).cast("double")
    each = F.array(cell("status", "state", F.col("l_linestatus"), no_sum, none), cell("price", E.MONEY, none, (F.col("l_quantity").cast("long") % 2).cast("double"), currency), cell("address", E.PLACE, said, no_sum, none))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("company_id"), line.alias("pos"), confidence.alias("confidence"), F.explode(each).alias("c")).select("company_id", "pos", "confidence", "c.*")
    k = F.col("o_orderkey")
    own = F.array(
        F.struct(F.lit("status").alias("field"), F.when(F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus")).alias("stored_value"), no_sum.alias("stored_amount"), none.alias("stored_currency")),
        F.struct(F.lit("price").alias("field"), none.alias("stored_value"), F.when(k % 3 > 0, (k % 2).cast("double")).alias("stored_amount"), F.when(k % 5 == 0, "AUD").alias("stored_currency")),
        F.struct(F.lit("address").alias("field"), F.when(k % 4 == 1, "1 HIGH STREET Perth WA 6000").when(k % 4 == 2, "6000").alias("stored_value"), no_sum.alias("stored_amount"), none.alias("stored_currency")),
    )
    return rows, table(spark, d, "orders").select(k.alias("company_id"), F.explode(own).alias("s")).select("company_id", "s.*")


@query(f"""
WITH {TYPED_SQL},
o AS (SELECT o_orderkey AS company_id, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS st, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 2)::DOUBLE END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'AUD' END AS cur, o_orderkey % 4 AS k FROM orders),
sm AS (SELECT company_id, count(*) AS n, min(amount) AS amount, min(cur) AS cur FROM (SELECT DISTINCT company_id, amount, CASE WHEN fc IS NOT NULL THEN coalesce(currency, fc) END AS cur FROM m) GROUP BY company_id),
sp AS (SELECT q.company_id, q.n, arg_min(c.p, (c.pos, [0, 3, 1, 2][c.p + 1])) AS p FROM q JOIN c USING (company_id) GROUP BY ALL),
j AS (
  SELECT c.company_id, 'status' AS field, count(DISTINCT c.st) AS n, any_value(o.st) IS NOT NULL AND any_value(o.st) <> min(c.st) AS differs FROM c LEFT JOIN o ON o.company_id = c.company_id GROUP BY c.company_id
  UNION ALL SELECT sm.company_id, 'price', sm.n, o.amount IS NOT NULL AND NOT (o.amount = sm.amount AND coalesce(o.cur = sm.cur, true)) FROM sm LEFT JOIN o ON o.company_id = sm.company_id
  UNION ALL SELECT sp.company_id, 'address', sp.n, k IN (1, 2) AND NOT (k = 2 OR sp.p <> 2) FROM sp LEFT JOIN o ON o.company_id = sp.company_id)
SELECT company_id, field, CASE WHEN n > 1 THEN 'sources_disagree' ELSE 'stored_differs' END AS kind, n::BIGINT AS "values" FROM j WHERE n > 1 OR differs
""")
def typed_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts of statuses, sums (a missing currency fits any) and addresses (by street and postcode)."""
    rows, own = typed_claims(spark, d)
    return E.typed_conflicts(rows, own, COLUMNS, "pos")


@query("""
WITH c AS (SELECT l_orderkey AS company_id, l_linestatus AS st, (l_quantity::BIGINT % 2)::DOUBLE AS amount, CASE l_linenumber % 3 WHEN 1 THEN 'AUD' WHEN 2 THEN 'USD' END AS currency, l_suppkey % 4 AS p,
  CASE WHEN l_quantity > 40 THEN 1.0 WHEN l_quantity > 15 THEN 0.7 ELSE 0.4 END::DOUBLE AS r FROM lineitem),
o AS (SELECT o_orderkey AS id, o_orderstatus AS st, (o_orderkey % 2)::DOUBLE AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'AUD' END AS cur, o_orderkey % 4 AS k FROM orders),
f AS (SELECT id, 'status' AS field, 4.0::DOUBLE AS w FROM o WHERE st IN ('O', 'F') UNION ALL SELECT id, 'price', 2.0 FROM o WHERE id % 3 > 0 UNION ALL SELECT id, 'address', 1.0 FROM o WHERE k IN (1, 2)),
j AS (SELECT f.id, f.field, f.w, c.r, CASE WHEN c.company_id IS NULL THEN NULL WHEN field = 'status' THEN c.st = o.st WHEN field = 'price' THEN c.amount = o.amount AND coalesce(c.currency = o.cur, true) ELSE k = 2 OR c.p <> 2 END AS same
  FROM f JOIN o ON o.id = f.id LEFT JOIN c ON c.company_id = f.id),
v AS (SELECT id, field, any_value(w) AS w, coalesce(max(r) FILTER (WHERE same), 0.25) AS own, count(*) FILTER (WHERE NOT same) AS other FROM j GROUP BY ALL),
s AS (SELECT id AS company_id, round(sum(w * CASE WHEN other > 0 THEN least(own, 0.2) ELSE own END) / sum(w), 2) AS score FROM v GROUP BY id)
SELECT company_id, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM s
""")
def typed_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows, own = typed_claims(spark, d)
    return E.typed_confidence(rows, own, COLUMNS, {"status": 4, "price": 2, "address": 1})
