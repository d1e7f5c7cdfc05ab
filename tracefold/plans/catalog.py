"""Selecting, ordering, paging, faceting and summing up the directory; customers stand for companies, nations for cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import catalog as C
from tracefold.plans.base import query
from tracefold.session import table

FIELDS = C.Fields(
    name="c_name", sector="c_mktsegment", sector_group="sector_group", city="n_name", metro="r_name", search=("c_name", "c_mktsegment", "n_name"),
    equal={"state": "r_name"}, flag={"hiring": "hiring"},
)
GROUPED = "CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'Industry' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Home' ELSE 'Other' END"
COMPANIES_SQL = f"""(SELECT c.*, n.n_name, r.r_name, {GROUPED} AS sector_group, c_acctbal > 5000 AS hiring
  FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey)"""


def companies(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.withColumns({"sector_group": F.expr(GROUPED), "hiring": F.col("c_acctbal") > 5000})


@query("""
SELECT n.n_name AS value, count(*)::BIGINT AS count FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY n.n_name ORDER BY count DESC, value LIMIT 8
""")
def facet_city_top8(spark: SparkSession, d: str) -> DataFrame:
    c = C.select(table(spark, d, "customer"), C.Filters(sector=("BUILDING", "MACHINERY")), C.Fields(name="c_name", sector="c_mktsegment"))
    n = table(spark, d, "nation")
    counts = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(8)


@query(f"""
SELECT c_custkey, c_name, c_mktsegment, n_name FROM {COMPANIES_SQL}
WHERE (c_mktsegment IN ('BUILDING', 'Home') OR sector_group IN ('BUILDING', 'Home')) AND (n_name IN ('NATION_3', 'NATION_7', 'REGION_1') OR r_name IN ('NATION_3', 'NATION_7', 'REGION_1')) AND hiring
""")
def select_or_sector_city(spark: SparkSession, d: str) -> DataFrame:
    f = C.Filters(sector=("BUILDING", "Home"), city=("NATION_3", "NATION_7", "REGION_1"), flag={"hiring": "yes"})
    return C.select(companies(spark, d), f, FIELDS).select("c_custkey", "c_name", "c_mktsegment", "n_name")


@query(f"""
SELECT c_custkey, c_name FROM {COMPANIES_SQL} WHERE contains(lower(c_name || chr(10) || c_mktsegment || chr(10) || n_name), 'nation_1')
OR contains(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 'nation1')
""")
def search_substring(spark: SparkSession, d: str) -> DataFrame:
    return C.select(companies(spark, d), C.Filters(search="NATION_1"), FIELDS).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 'customer00000001')")
def search_tight(spark: SparkSession, d: str) -> DataFrame:
    t = C.Fields(name="c_name", search=("c_name",))
    return C.select(table(spark, d, "customer"), C.Filters(search="customer 0000 0001"), t).select("c_custkey", "c_name")


@query("""
SELECT p_partkey, p_name, CASE WHEN starts_with(lower(p_name), 'ring') THEN 0 WHEN contains(lower(p_name), ' ring') THEN 1 WHEN contains(lower(p_name), 'ring') THEN 2 END::INTEGER AS tier
FROM part WHERE contains(lower(p_name), 'ring')
ORDER BY tier, CASE WHEN starts_with(lower(p_name), 'ring') THEN lower(p_name) END, p_partkey LIMIT 7
""")
def suggest_tiers(spark: SparkSession, d: str) -> DataFrame:
    return C.suggest(table(spark, d, "part"), "Ring", "p_name", "p_partkey", limit=7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return C.page(C.order_by(rows, [], "c_name", "c_custkey"), 40, 20).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 OR (o_totalprice = 100000 AND o_orderkey > 0) ORDER BY o_totalprice, o_orderkey LIMIT 25")
def page_keyset(spark: SparkSession, d: str) -> DataFrame:
    return C.page_after(table(spark, d, "orders"), "o_totalprice", "o_orderkey", (100000.0, 0), 25).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Series A' WHEN 2 THEN 'Moonshot' WHEN 3 THEN 'Unknown' END AS stage, n AS rank
FROM (SELECT *, CASE c_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 16 ELSE 17 END::INTEGER AS n FROM customer) ORDER BY n, c_name, c_custkey LIMIT 50
""")
def sort_rank_then_name(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey") % 5
    stage = F.when(n == 0, "Seed").when(n == 1, "Series A").when(n == 2, "Moonshot").when(n == 3, "Unknown")
    rows = table(spark, d, "customer").withColumn("stage", stage).withColumn("rank", C.stage_rank(F.col("stage")))
    return C.page(C.order_by(rows, [F.col("rank")], "c_name", "c_custkey"), 0, 50).select("c_custkey", "stage", "rank")


@query(f"""
WITH u AS (SELECT 'sector' AS facet, c_mktsegment AS value FROM customer UNION ALL SELECT 'city', n_name FROM {COMPANIES_SQL} UNION ALL SELECT 'group', sector_group FROM {COMPANIES_SQL}),
c AS (SELECT facet, value, count(*) AS count FROM u GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY facet) AS "distinct", row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS n FROM c)
SELECT facet, value, count::BIGINT AS count, "distinct"::BIGINT AS "distinct" FROM r WHERE n <= 10
""")
def facet_multi(spark: SparkSession, d: str) -> DataFrame:
    return C.facets(companies(spark, d), {"sector": "c_mktsegment", "city": "n_name", "group": "sector_group"}, top=10)


@query("""
SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS count, grouping(c_mktsegment)::BIGINT AS g FROM customer
GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))
""")
def facet_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_sets(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "g")


@query(f"""
SELECT count(*)::BIGINT AS count, count(*) FILTER (WHERE hiring)::BIGINT AS hiring, count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS below,
count(DISTINCT n_name)::BIGINT AS cities, count(DISTINCT c_mktsegment)::BIGINT AS sectors, max(c_acctbal) AS newest FROM {COMPANIES_SQL}
""")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = {"hiring": F.col("hiring"), "below": F.col("c_acctbal") < 0}
    return C.summary(companies(spark, d), flags, {"cities": "n_name", "sectors": "c_mktsegment"}, {"newest": "c_acctbal"})


@query(f"""
SELECT 'all' AS "set", count(*)::BIGINT AS count FROM customer UNION ALL
SELECT 'hiring', count(*) FROM {COMPANIES_SQL} WHERE hiring UNION ALL
SELECT 'home', count(*) FROM {COMPANIES_SQL} WHERE sector_group = 'Home' UNION ALL
SELECT 'home_idle', count(*) FROM {COMPANIES_SQL} WHERE sector_group = 'Home' AND NOT hiring
""")
def counts_batch(spark: SparkSession, d: str) -> DataFrame:
    sets = {"all": C.Filters(), "hiring": C.Filters(flag={"hiring": "yes"}), "home": C.Filters(sector=("Home",)), "home_idle": C.Filters(sector=("Home",), flag={"hiring": "no"})}
    return C.batch_counts(companies(spark, d), sets, FIELDS)


@query("SELECT count(*)::BIGINT AS examined, count(*) FILTER (WHERE c_mktsegment = 'BUILDING')::BIGINT AS matched FROM customer")
def explain_selection(spark: SparkSession, d: str) -> DataFrame:
    return C.explain_selection(table(spark, d, "customer"), C.Filters(sector=("BUILDING",)), C.Fields(name="c_name", sector="c_mktsegment"))


@query("""
WITH b AS (SELECT CASE WHEN p_size BETWEEN 1 AND 9 THEN '1-9' WHEN p_size BETWEEN 10 AND 29 THEN '10-29' WHEN p_size BETWEEN 30 AND 99 THEN '30-99' WHEN p_size >= 100 THEN '100plus' END AS bucket FROM part)
SELECT bucket, count(*)::BIGINT AS count FROM b GROUP BY bucket
""")
def team_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(C.team_bucket(F.col("p_size")).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


@query("""
WITH c AS (SELECT n_name, lower(c_name) AS k, c_name, c_custkey, row_number() OVER (PARTITION BY n_name ORDER BY lower(c_name), c_custkey) AS r, count(*) OVER (PARTITION BY n_name) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name, max(n)::BIGINT AS count, string_agg(c_name, ',' ORDER BY r) AS sample FROM c WHERE r <= 12 GROUP BY n_name
""")
def area_groups_sample(spark: SparkSession, d: str) -> DataFrame:
    a = C.areas(companies(spark, d), ["n_name"], "c_name", "c_custkey")
    return a.select("n_name", "count", F.array_join("sample", ",").alias("sample"))


@query("""
SELECT min(p_retailprice) AS least, max(p_retailprice) AS most, count(DISTINCT p_brand)::BIGINT AS brands, count(DISTINCT p_type)::BIGINT AS types,
(SELECT string_agg(p_brand, ',' ORDER BY p_brand) FROM (SELECT DISTINCT p_brand FROM part)) AS vocabulary FROM part
""")
def meta_vocab(spark: SparkSession, d: str) -> DataFrame:
    return C.vocabulary(table(spark, d, "part"), {"p_retailprice": ("least", "most")}, {"brands": "p_brand", "types": "p_type"}, {"vocabulary": "p_brand"})


@query("""
SELECT c_nationkey AS lat, c_mktsegment AS lng, count(*)::BIGINT AS count FROM customer GROUP BY ALL HAVING count(*) > 1 ORDER BY count DESC, lat, lng LIMIT 5
""")
def pin_stacks(spark: SparkSession, d: str) -> DataFrame:
    return C.pin_stacks(table(spark, d, "customer").select(F.col("c_nationkey").alias("lat"), F.col("c_mktsegment").alias("lng")), "lat", "lng")


@query("""
SELECT p_partkey, p_partkey::VARCHAR || ',' || p_name || ',"' || p_brand || ', ""new""' || '",' || CASE WHEN p_size > 25 THEN '''=' || p_size::VARCHAR ELSE p_size::VARCHAR END AS line FROM part
""")
def export_csv_guarded(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.concat(F.lit("="), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    columns = {"id": F.col("p_partkey"), "name": F.col("p_name"), "brand": F.concat("p_brand", F.lit(', "new"')), "size": size}
    return C.csv_lines(table(spark, d, "part"), columns, ["p_partkey"])
