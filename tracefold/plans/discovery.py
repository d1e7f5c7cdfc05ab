"""A discovery run over leads that four sources have of each customer, some of them misspelt, nameless or told twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import discovery
from tracefold.plans.base import query
from tracefold.plans.resolution import customers, identities, made_name

_SYLLABLES = "['ka', 'lo', 'mi', 'tur', 'ben', 'sol', 'ra', 've', 'dan', 'pix', 'qui', 'fen', 'zor', 'hu', 'gra', 'wes', 'yt', 'omb', 'cli', 'eph']"


@query(f"""
WITH c AS (
  SELECT c_custkey AS k, c_nationkey AS city, array_to_string(list_transform(range(0, 5), lambda i: ({_SYLLABLES})[(((c_custkey * 792413) // (20 ** i)::BIGINT) % 20 + 1)::INTEGER]), '') AS name FROM customer),
v AS (
  SELECT k * 4 + v AS id, k, v, city, name || k || '.example' AS own, ((k * 4 + v) * 48271) % 2147483647 AS pos,
    CASE WHEN v = 2 AND k % 11 = 0 THEN '' WHEN v = 0 THEN name WHEN v = 1 THEN name[1:3] || 'x' || name[4:] WHEN v = 2 THEN reverse(name) ELSE name || 'works' END AS n,
    CASE WHEN v = 3 AND k % 5 = 0 THEN k || '-0' ELSE k || '-' || v END AS key, v = 3 AND k % 2 = 0 AS bare
  FROM c, range(4) r(v)),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS again FROM v WHERE n <> ''),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM f WHERE again = 1),
t AS (SELECT id, k, pos, r, n, city, bare FROM l UNION ALL SELECT -k, k, -1, 0, name, city, false FROM c WHERE k % 3 = 0),
p AS (SELECT a.k, a.id, a.r, b.id AS b_id, b.r AS b_r, a.n AS a, b.n AS b,
    list_transform(range(1, length(a.n)), lambda i: a.n[i:i + 1]) AS ga, list_transform(range(1, length(b.n)), lambda i: b.n[i:i + 1]) AS gb
  FROM t a JOIN t b ON a.k = b.k AND a.r > b.r WHERE NOT a.bare AND NOT b.bare),
s AS (SELECT *, greatest(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)),
    2.0 * list_sum(list_transform(list_distinct(ga), lambda x: least(len(list_filter(ga, lambda y: y = x)), len(list_filter(gb, lambda y: y = x))))) / (length(a) + length(b) - 2)) AS sim FROM p),
w AS (SELECT *, CASE WHEN a = b THEN 0.6 WHEN sim >= 0.84 THEN round(0.2 + 0.2 * (sim - 0.84) / (1 - 0.84), 2)
    WHEN abs(length(a) - length(b)) >= 2 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0.2 END AS weight FROM s),
e AS (SELECT k, id, r, b_id, b_r, round(0.9 + 0.1 * least(1, (0.9 + weight + 0.1) / 1.6), 2) AS score FROM w WHERE weight IS NOT NULL),
m AS (SELECT id, min(b_id) AS company FROM e WHERE b_r = 0 GROUP BY id),
g AS (
  WITH RECURSIVE walk AS (
    SELECT k, 0 AS r, []::BIGINT[] AS roots FROM (SELECT DISTINCT k FROM l)
    UNION ALL
    SELECT walk.k, walk.r + 1, CASE WHEN m.company IS NULL AND EXISTS (SELECT 1 FROM e WHERE e.id = l.id AND list_contains(walk.roots, e.b_id)) THEN walk.roots ELSE list_append(walk.roots, l.id) END
    FROM walk JOIN l ON l.k = walk.k AND l.r = walk.r + 1 LEFT JOIN m ON m.id = l.id)
  SELECT k, arg_max(roots, r) AS roots FROM walk GROUP BY k),
b AS (SELECT e.id, arg_min(e.b_id, (-e.score, e.b_r)) AS target FROM e JOIN g ON g.k = e.k WHERE e.b_r > 0 AND list_contains(g.roots, e.b_id) GROUP BY e.id)
SELECT v.id AS lead_id, CASE WHEN v.n = '' THEN 'skipped' WHEN l.id IS NULL THEN 'seen' WHEN m.company IS NOT NULL THEN 'matched' WHEN list_contains(g.roots, v.id) THEN 'kept' ELSE 'attached' END AS state,
  CASE WHEN m.company IS NOT NULL THEN -m.company WHEN l.id IS NOT NULL AND NOT list_contains(g.roots, v.id) THEN b.target END AS target_id
FROM v LEFT JOIN l ON l.id = v.id LEFT JOIN m ON m.id = v.id LEFT JOIN g ON g.k = v.k LEFT JOIN b ON b.id = v.id
""")
def discovery_run(spark: SparkSession, d: str) -> DataFrame:
    """Leads about customers, a third of which are companies already; tests hold every state against a run one by one."""
    c = customers(spark, d)
    key = F.col("c_custkey")
    name = made_name(key * 792_413)
    site = F.concat(name, key.cast("string"), F.lit(".example"))
    companies = identities(c.where("c_custkey % 3 = 0").withColumn("id", key), name, site)
    v = F.col("v")
    told = c.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("id", key * 4 + v)
    spelt = F.when((v == 2) & (key % 11 == 0), "").when(v == 0, name).when(v == 1, F.concat(F.substring(name, 1, 3), F.lit("x"), F.substring(name, 4, 40))).when(v == 2, F.reverse(name)).otherwise(F.concat(name, F.lit("works")))
    told = told.withColumns({"spelt": spelt, "site": F.when(~((v == 3) & (key % 2 == 0)), site)})
    leads = identities(told, F.col("spelt"), F.col("site"))
    about = told.select(
        "id", (F.col("id") * 48271 % 2147483647).alias("pos"), F.lit("one").alias("source_id"),
        F.concat_ws("-", key.cast("string"), F.when((v == 3) & (key % 5 == 0), 0).otherwise(v).cast("string")).alias("key"), F.col("spelt").alias("name"),
    )
    found = discovery.run(leads.join(about.hint("merge"), "id"), companies)
    state = F.when(F.col("state").isin("review", "new"), "kept").otherwise(F.col("state"))
    return found.select("lead_id", state.alias("state"), F.when(state.isin("matched", "attached"), F.col("target_id").cast("long")).alias("target_id"))
