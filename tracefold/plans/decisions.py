"""Merged records, identifiers with one owner, versions put together, conflicts that decisions settle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import merges, settle
from tracefold.plans.base import query
from tracefold.session import table


@query("""
WITH m AS (
  SELECT c_custkey AS old, CASE WHEN c_custkey % 10 = 7 THEN c_custkey - 1 WHEN c_custkey % 10 = 9 THEN -c_custkey ELSE c_custkey + 1 END AS new
  FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 6, 7, 9)),
bad AS (SELECT old FROM m WHERE new < 0 OR (new NOT IN (SELECT c_custkey FROM customer) AND new NOT IN (SELECT old FROM m))),
w AS (
  WITH RECURSIVE w AS (
    SELECT old, new, 1 AS d FROM m WHERE old NOT IN (SELECT old FROM bad)
    UNION ALL SELECT w.old, m.new, d + 1 FROM w JOIN m ON m.old = w.new WHERE d < 12 AND m.old NOT IN (SELECT old FROM bad))
  SELECT old, arg_max(new, d) AS new, max(d) AS d FROM w GROUP BY old),
c AS (SELECT old, new FROM w WHERE d < 12),
o AS (SELECT o_orderkey AS id, coalesce(new, o_custkey) AS k, new IS NOT NULL AS moved, year(o_orderdate) || o_orderpriority AS u FROM orders LEFT JOIN c ON old = o_custkey),
p AS (SELECT *, row_number() OVER (PARTITION BY k, u ORDER BY moved, id) AS r FROM o),
e AS (SELECT coalesce(new, user_id) AS k, new IS NOT NULL AS moved FROM events LEFT JOIN c ON old = user_id),
n AS (
  SELECT new AS k, count(*) AS merged, sum(old)::BIGINT AS old_ids FROM c GROUP BY new)
SELECT cu.c_custkey, coalesce(merged, 0)::BIGINT AS aliases, coalesce(a.kept, 0)::BIGINT AS orders, coalesce(a.moved, 0)::BIGINT AS moved_orders, coalesce(a.gone, 0)::BIGINT AS dropped_orders,
  coalesce(b.n, 0)::BIGINT AS events, coalesce(b.moved, 0)::BIGINT AS moved_events, cu.c_custkey IN (SELECT old FROM m WHERE old NOT IN (SELECT old FROM c)) AS refused
FROM customer cu LEFT JOIN n ON n.k = cu.c_custkey
LEFT JOIN (SELECT k, count(*) FILTER (WHERE NOT (moved AND r > 1)) AS kept, count(*) FILTER (WHERE moved AND r = 1) AS moved, count(*) FILTER (WHERE moved AND r > 1) AS gone FROM p GROUP BY k) a ON a.k = cu.c_custkey
LEFT JOIN (SELECT k, count(*) AS n, count(*) FILTER (WHERE moved) AS moved FROM e GROUP BY k) b ON b.k = cu.c_custkey
WHERE cu.c_custkey NOT IN (SELECT old FROM c)
""")
def merge_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Customers merged in chains of three, round circles and into nobody; their orders (one a year and priority) and events follow."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    to = F.when(k % 10 == 7, k - 1).when(k % 10 == 9, -k).otherwise(k + 1)
    asked = c.where((k % 10).isin(1, 2, 3, 6, 7, 9)).select(k.alias("old"), to.alias("new"))
    records = c.select("c_custkey", "c_name", F.array().cast("array<string>").alias("aliases"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    events = table(spark, d, "events").select("event_id", "user_id")
    refs = {"orders": merges.Reference(orders, "o_orderkey", ("o_custkey",), ("year", "o_orderpriority")), "events": merges.Reference(events, "event_id", ("user_id",))}
    done = merges.merge_records(records, "c_custkey", "c_name", "aliases", asked, refs)
    kept = done.tables["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.count_if("moved").alias("moved_orders"))
    gone = done.dropped["orders"].join(orders, "o_orderkey").join(done.redirects.withColumnRenamed("old", "o_custkey"), "o_custkey").groupBy(F.col("new").alias("c_custkey")).agg(F.count(F.lit(1)).alias("dropped_orders"))
    seen = done.tables["events"].groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("events"), F.count_if("moved").alias("moved_events"))
    refused = done.refused.select(F.col("old").alias("c_custkey"), F.lit(True).alias("refused"))
    out = done.records.select("c_custkey", F.size("aliases").cast("long").alias("aliases"))
    for t in (kept, gone, seen, refused):
        out = out.join(t, "c_custkey", "left")
    return out.na.fill(0).na.fill(False)


@query("""
WITH r AS (SELECT c_custkey AS record, ['domain', 'abn', 'alias'][c_custkey % 3 + 1] AS scheme, CASE WHEN c_custkey % 2 = 0 THEN 'V' ELSE 'v' END || (c_custkey // 3) % 50 AS value, c_custkey % 5 = 0 AS has FROM customer),
k AS (SELECT *, CASE WHEN scheme = 'domain' THEN lower(value) ELSE value END AS key, CASE WHEN scheme = 'alias' THEN record END AS scope, CASE WHEN has THEN -1 ELSE record END AS p FROM r),
o AS (SELECT scheme, key, scope, arg_min(record, (p, record)) AS owner FROM k GROUP BY ALL)
SELECT k.record, k.scheme, k.value, CASE WHEN owner = k.record THEN 'added' ELSE 'held' END AS outcome, owner FROM k JOIN o ON o.scheme = k.scheme AND o.key = k.key AND o.scope IS NOT DISTINCT FROM k.scope WHERE NOT has
""")
def identifiers_claimed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    scheme = F.element_at(F.array(*map(F.lit, ("domain", "abn", "alias"))), (k % 3 + 1).cast("int"))
    value = F.concat(F.when(k % 2 == 0, "V").otherwise("v"), (F.floor(k / 3) % 50).cast("string"))
    rows = table(spark, d, "customer").select(k.alias("record"), scheme.alias("scheme"), value.alias("value"), k.alias("pos"), (k % 5 == 0).alias("has"))
    return merges.claim_identifiers(rows.where("has"), rows.where("NOT has"), {"domain": "lower(value)"}).select("record", "scheme", "value", "outcome", "owner")


@query("""
WITH b AS (SELECT o_orderkey AS k, 'status' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
o AS (SELECT k, field, CASE WHEN field = 'status' AND k % 7 = 0 THEN 'X' WHEN field = 'priority' AND k % 11 = 0 THEN NULL ELSE v END AS v FROM b),
t AS (SELECT k, field, CASE WHEN field = 'status' AND k % 21 = 0 THEN 'X' WHEN field = 'status' AND k % 5 = 0 THEN 'Y' WHEN field = 'priority' AND k % 22 = 0 THEN NULL WHEN field = 'priority' AND k % 33 = 0 THEN 'soon' ELSE v END AS v FROM b),
j AS (SELECT b.k, b.field, b.v AS b, o.v AS o, t.v AS t FROM b JOIN o USING (k, field) JOIN t USING (k, field)),
s AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM b AND t IS NOT DISTINCT FROM b THEN 'same' WHEN t IS NOT DISTINCT FROM b THEN 'ours' WHEN o IS NOT DISTINCT FROM b THEN 'theirs' WHEN o IS NOT DISTINCT FROM t THEN 'both' ELSE 'conflict' END AS state FROM j)
SELECT k AS o_orderkey, field, state, CASE WHEN state IN ('ours', 'both') THEN o WHEN state = 'theirs' THEN t ELSE b END AS value, o AS ours, t AS theirs FROM s
""")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two edited versions of the orders put together."""
    cells = table(spark, d, "orders").select("o_orderkey", F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("field", "value"))
    k, status = F.col("o_orderkey"), F.col("field") == "status"
    none = F.lit(None).cast("string")
    ours = F.when(status & (k % 7 == 0), "X").when(~status & (k % 11 == 0), none).otherwise(F.col("value"))
    theirs = F.when(status & (k % 21 == 0), "X").when(status & (k % 5 == 0), "Y").when(~status & (k % 22 == 0), none).when(~status & (k % 33 == 0), "soon").otherwise(F.col("value"))
    return settle.three_way(cells, cells.withColumn("value", ours), cells.withColumn("value", theirs), ["o_orderkey", "field"])


@query("""
WITH c AS (SELECT l_orderkey AS s, lower(l_returnflag) AS k, l_returnflag AS v, l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_tax < 0.07),
pv AS (SELECT s, k, count(*)::BIGINT AS n, arg_min(CASE WHEN id % 2 = 0 THEN ' ' || v ELSE v END, id) AS said FROM c GROUP BY s, k),
st AS (SELECT o_orderkey AS s, ['A', 'N', 'r'][o_orderkey % 4 + 1] AS before FROM orders WHERE o_orderkey % 4 < 3),
f AS (SELECT coalesce(p.s, st.s) AS s, st.before, lower(st.before) AS bk, p.claims, p.vals, p.only_k,
    coalesce(vals, 0) > 1 OR (coalesce(vals, 0) = 1 AND before IS NOT NULL AND only_k <> lower(before)) AS open
  FROM (SELECT s, sum(n)::BIGINT AS claims, count(*) AS vals, min(k) AS only_k FROM pv GROUP BY s) p FULL JOIN st ON st.s = p.s),
e AS (SELECT event_id AS id, event_id - event_id % 3 AS s, event_type AS t, value >= 20 AS good,
    coalesce(min(CASE WHEN event_type <> 'error' THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), (SELECT max(event_id) + 1 FROM events)) - event_id - 1 AS undos FROM events),
h AS (SELECT e.id, e.s, CASE t WHEN 'purchase' THEN 'dismiss' ELSE 'settle' END AS kind, CASE t WHEN 'view' THEN 'a' WHEN 'signup' THEN 'n' WHEN 'purchase' THEN 'r' END AS w, good FROM e WHERE t <> 'error' AND undos % 2 = 0),
j AS (SELECT h.*, coalesce(w, bk) AS wk, CASE WHEN w IS NULL THEN before ELSE said END AS chosen,
    CASE WHEN NOT good THEN 'no reason' WHEN w IS NULL AND before IS NULL THEN 'no value on record' WHEN w IS NOT NULL AND said IS NULL THEN 'not claimed' WHEN kind = 'settle' AND NOT coalesce(open, false) THEN 'not in conflict' END AS why
  FROM h LEFT JOIN f ON f.s = h.s LEFT JOIN pv ON pv.s = h.s AND pv.k = h.w),
x AS (SELECT s, max(id) AS id, arg_max(wk, id) AS wk, arg_max(chosen, id) AS chosen FROM j WHERE why IS NULL AND kind = 'settle' GROUP BY s),
n AS (SELECT DISTINCT s, wk AS k FROM j WHERE why IS NULL AND kind = 'dismiss'),
l AS (SELECT pv.s, pv.k, pv.n, coalesce(x.wk <> pv.k, false) OR (n.k IS NOT NULL AND NOT coalesce(x.wk = pv.k, false)) AS lost FROM pv LEFT JOIN x ON x.s = pv.s LEFT JOIN n ON n.s = pv.s AND n.k = pv.k),
d AS (SELECT s, coalesce(sum(n) FILTER (WHERE lost), 0)::BIGINT AS down, count(*) FILTER (WHERE NOT lost) AS still, min(k) FILTER (WHERE NOT lost) AS lk FROM l GROUP BY s),
r AS (SELECT s, arg_max(why, id) AS why FROM j WHERE why IS NOT NULL GROUP BY s)
SELECT coalesce(f.s, r.s) AS l_orderkey, before, CASE WHEN x.id IS NULL OR x.wk IS NOT DISTINCT FROM bk THEN before ELSE chosen END AS value,
  CASE WHEN x.id IS NOT NULL THEN 'settled' WHEN coalesce(still, 0) > 1 OR (coalesce(still, 0) = 1 AND before IS NOT NULL AND lk <> bk) THEN 'open' ELSE 'agreed' END AS state,
  coalesce(claims, 0)::BIGINT AS claims, coalesce(down, 0)::BIGINT AS turned_down, x.id AS decision, why
FROM f LEFT JOIN x ON x.s = f.s LEFT JOIN d ON d.s = f.s FULL JOIN r ON r.s = f.s
""")
def settled_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What the lines of an order claim, against a record of it, after three decisions each, some undone, some undone twice."""
    claim = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    claims = table(spark, d, "lineitem").select("l_orderkey", claim.alias("claim_id"), F.concat(F.when(claim % 2 == 0, " ").otherwise(""), "l_returnflag").alias("value"), F.when(F.col("l_tax") < 0.07, "active").otherwise("rejected").alias("status"))
    k = F.col("o_orderkey")
    stored = table(spark, d, "orders").select(k.alias("l_orderkey"), F.when(k % 4 == 0, "A").when(k % 4 == 1, "N").when(k % 4 == 2, "r").alias("value"))
    e, t = F.col("event_id"), F.col("event_type")
    decisions = table(spark, d, "events").select(
        e.alias("id"), (e - e % 3).alias("l_orderkey"), F.when(t == "error", "undo").when(t == "purchase", "dismiss").otherwise("settle").alias("kind"),
        F.when(t == "view", "A").when(t == "signup", " n").when(t == "purchase", "R").alias("winner"), F.when(F.col("value") >= 20, "seen on the page").otherwise(" no ").alias("reason"), F.when(t == "error", e - 1).alias("undoes"),
    )
    return settle.settle(claims, stored, decisions, ["l_orderkey"])
