"""Cards, markers, investors, sectors and roles; customers stand for companies, suppliers for investors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import geo, roles, sectors
from tracefold.operators import investors as I
from tracefold.operators.evidence import text_key
from tracefold.plans.base import query
from tracefold.session import table

LABELS = ("healthtech", "SaaS ", "VR", "Open banking", "Basket weaving", "Unknown", "N/A", "Community", "EdTech", "Green ammonia", "alt-protein", "Packaging")


def _pick(values: tuple, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


@query("""
WITH m(i, label, grp) AS (VALUES (0, 'healthtech', 'Health & Biotech'), (1, 'SaaS ', 'Software & DevTools'), (2, 'VR', 'Deep Tech & Space'), (3, 'Open banking', 'Fintech'), (4, 'Basket weaving', 'Other'),
  (5, 'Unknown', NULL), (6, 'N/A', NULL), (7, 'Community', 'Other'), (8, 'EdTech', 'Education'), (9, 'Green ammonia', 'Climate & Energy'), (10, 'alt-protein', 'Food & Agriculture'), (11, 'Packaging', 'Industrial & Logistics'))
SELECT p_partkey, grp AS sector_group, label <> 'Basket weaving' AS placed FROM part JOIN m ON i = p_partkey % 12
""")
def sector_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", _pick(LABELS, F.col("p_partkey")).alias("label"))
    return rows.select("p_partkey", sectors.group_of(F.col("label")).alias("sector_group"), sectors.is_placed(F.col("label")).alias("placed"))


TITLES = ("Talent Partner", "Operating Partner", "General  Partner", "Venture Scout", "Baker", " ", "Head of People", "VP of Investments", "Legal & Counsel", "Analyst/Associate")


@query("""
WITH m(i, cls) AS (VALUES (0, 'talent'), (1, 'platform'), (2, 'investment'), (3, 'scout'), (4, 'other'), (5, NULL), (6, 'talent'), (7, 'investment'), (8, 'platform'), (9, 'investment'))
SELECT cls AS role_class, count(*)::BIGINT AS people FROM customer JOIN m ON i = c_custkey % 10 GROUP BY cls
""")
def role_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(roles.role_class(_pick(TITLES, F.col("c_custkey"))).alias("role_class"))
    return rows.groupBy("role_class").agg(F.count(F.lit(1)).alias("people"))


@query("""
WITH p AS (SELECT c_custkey, -44 + (c_custkey % 90) * 0.4 AS lat, 112 + ((c_custkey * 7) % 110) * 0.4 AS lng, CASE c_custkey % 3 WHEN 0 THEN 'NSW' WHEN 1 THEN 'QLD' ELSE 'WA' END AS state FROM customer),
b(code, o, south, north, west, east) AS (VALUES ('NSW', 0, -37.55, -28.1, 140.95, 153.7), ('VIC', 1, -39.2, -33.95, 140.9, 150.05), ('QLD', 2, -29.2, -9.1, 137.95, 153.6), ('SA', 3, -38.1, -25.95, 128.95, 141.05),
  ('WA', 4, -35.2, -13.65, 112.85, 129.05), ('TAS', 5, -43.75, -39.15, 143.7, 148.6), ('NT', 6, -26.05, -10.9, 128.95, 138.05), ('ACT', 7, -35.95, -35.1, 148.7, 149.45)),
j AS (SELECT c_custkey, p.state, string_agg(code, ',' ORDER BY o) AS states, bool_or(code = p.state) AS own FROM p LEFT JOIN b ON lat BETWEEN south AND north AND lng BETWEEN west AND east GROUP BY ALL)
SELECT c_custkey, coalesce(states, '') AS states, states IS NOT NULL AND NOT coalesce(own, false) AS conflict FROM j
""")
def points_in_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lng = -44 + (k % 90) * 0.4, 112 + ((k * 7) % 110) * 0.4
    rows = table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lng.alias("lng"), _pick(("NSW", "QLD", "WA"), k).alias("state"))
    at = geo.states_at(F.col("lat"), F.col("lng"))
    return rows.select("c_custkey", F.array_join(at, ",").alias("states"), geo.conflicts_with_state(F.col("lat"), F.col("lng"), F.col("state")).alias("conflict"))


@query("""
SELECT c_custkey, '{' || array_to_string(list_filter(['"name":"' || c_name || '"', '"slug":"c-' || c_custkey || '"', '"sector":"' || c_mktsegment || '"', CASE WHEN c_nationkey % 4 <> 0 THEN '"city":"n' || c_nationkey || '"' END,
  '"hiring":' || (c_acctbal > 0)::VARCHAR, CASE WHEN c_custkey % 3 = 0 THEN '"website":"https://c' || c_custkey || '.example"' END], lambda x: x IS NOT NULL), ',') || '}' AS card FROM customer
""")
def company_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 3 == 0, F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example"))).alias("website"), F.col("c_name").alias("name"),
        F.concat(F.lit("c-"), k.cast("string")).alias("slug"), F.col("c_mktsegment").alias("sector"), (F.col("c_acctbal") > 0).alias("hiring"), F.lit("inside only").alias("notes"),
        F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("city"),
    )
    return I.card(rows).select("c_custkey", "card")


@query("""
SELECT 'c-' || c_custkey AS slug, c_name AS name, (-33.0 - (c_custkey % 10))::DOUBLE AS lat, 150.5::DOUBLE AS lng, c_mktsegment AS sector, 'Sydney' AS city, (c_acctbal > 0)::INTEGER AS hiring, NULL::VARCHAR AS domain,
  CASE c_custkey % 3 WHEN 0 THEN 'EXACT' ELSE 'SUBURB' END AS precision, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Newtown, Sydney' END AS place, (c_custkey % 2)::INTEGER AS checked, NULL::VARCHAR AS logo,
  'Sydney' AS metro, NULL::VARCHAR AS "sectorGroup", 'Newtown' AS suburb FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
""")
def map_markers(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    return I.markers(
        table(spark, d, "customer").select(
            F.concat(F.lit("c-"), k.cast("string")).alias("slug"), F.col("c_name").alias("name"), F.when(k % 7 != 0, -33.0 - (k % 10)).alias("lat"), F.lit(150.5).alias("lng"), F.col("c_mktsegment").alias("sector"),
            F.lit("Sydney").alias("city"), (F.col("c_acctbal") > 0).alias("hiring"), none.alias("domain"), _pick(("EXACT", "SUBURB", "CITY"), k).alias("precision"),
            F.when(k % 4 != 0, "Newtown, Sydney").alias("place"), (k % 2 == 1).alias("checked"), none.alias("logo"), F.lit("Sydney").alias("metro"), none.alias("sectorGroup"),
            F.lit("Newtown").alias("suburb"), (k % 5 != 0).alias("verified"),
        )
    )


ENTRIES_SQL = """(SELECT s_suppkey AS k, 's-' || s_suppkey AS slug, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'person' ELSE 'firm' END AS kind, CASE s_nationkey % 2 WHEN 0 THEN 'au' ELSE 'global' END AS scope,
  CASE s_suppkey % 3 WHEN 0 THEN 'vc' WHEN 1 THEN 'angel' ELSE 'fund' END AS type, CASE s_suppkey % 4 WHEN 0 THEN ['Seed', 'Series A'] WHEN 1 THEN ['Pre-seed'] WHEN 2 THEN [] ELSE ['Series A'] END AS stages,
  ['n' || s_nationkey] AS places, CASE s_suppkey % 7 WHEN 0 THEN 'both' WHEN 1 THEN 'lead' WHEN 2 THEN 'follow' END AS lead, CASE WHEN s_suppkey % 11 = 0 THEN 'inactive' ELSE 'published' END AS status,
  CASE WHEN s_suppkey % 2 = 0 THEN 'active' END AS active, s_acctbal AS low, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal + 2000 END AS high, CASE WHEN s_suppkey % 6 <> 0 THEN 'AUD' ELSE 'USD' END AS cur FROM supplier)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    stages = F.when(k % 4 == 0, F.array(F.lit("Seed"), F.lit("Series A"))).when(k % 4 == 1, F.array(F.lit("Pre-seed"))).when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("Series A")))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("s-"), k.cast("string")).alias("slug"), F.col("s_name").alias("name"), F.col("s_name").alias("search"), F.array(F.concat(F.lit("Été "), k.cast("string"))).alias("aliases"),
        F.when(k % 5 == 0, "person").otherwise("firm").alias("kind"), F.when(nation % 2 == 0, "au").otherwise("global").alias("scope"), _pick(("vc", "angel", "fund"), k).alias("type"), stages.alias("stages"),
        F.array().cast("array<string>").alias("sectors"), F.array(F.concat(F.lit("n"), nation.cast("string"))).alias("places"), F.when(k % 7 == 0, "both").when(k % 7 == 1, "lead").when(k % 7 == 2, "follow").alias("lead_or_follow"),
        F.when(k % 11 == 0, "inactive").otherwise("published").alias("status"), F.when(k % 2 == 0, "active").alias("active_status"), F.lit(None).cast("string").alias("role_class"),
        F.col("s_acctbal").alias("cheque_low"), F.when(k % 3 != 0, F.col("s_acctbal") + 2000).alias("cheque_high"), F.when(k % 6 != 0, "AUD").otherwise("USD").alias("cheque_currency"),
        (k % 9).alias("portfolio_count"), F.when(k % 4 != 0, F.concat(F.lit("n"), nation.cast("string"))).alias("location"),
    )


@query(f"""
SELECT slug, 'cheque' AS question FROM {ENTRIES_SQL} WHERE kind = 'firm' AND cur = 'AUD' AND coalesce(low <= 6000, true) AND coalesce(high >= 3000, true) AND type IN ('vc', 'angel') AND list_has_any(stages, ['Seed', 'Pre-seed']) UNION ALL
SELECT slug, 'lead' FROM {ENTRIES_SQL} WHERE kind = 'firm' AND lead IN ('lead', 'both') AND scope = 'au' AND (active = 'active' OR status = 'inactive') UNION ALL
SELECT slug, 'person' FROM {ENTRIES_SQL} WHERE kind = 'person' AND list_has_any(places, ['n1', 'n2', 'n3', 'n4']) UNION ALL
SELECT slug, 'name' FROM {ENTRIES_SQL} WHERE kind = 'firm' AND k IN (3, 4, 5)
""")
def select_investors(spark: SparkSession, d: str) -> DataFrame:
    """Four questions to the investors, each a condition of its own, in one pass."""
    asked = {
        "cheque": I.Wanted(cheque_min=3000, cheque_max=6000, types=("vc", "angel"), stages=("Seed", "Pre-seed")),
        "lead": I.Wanted(kind="all", lead=("lead",), scope="au", active=("active", "inactive")),
        "person": I.Wanted(kind="person", places=("n1", "n2", "n3", "n4")),
        "name": I.Wanted(kind="all", names=("ete 3", "ÉTÉ  4", "ete 5")),
    }
    met = F.array_compact(F.array(*[F.when(I.wanted(w), F.lit(q)) for q, w in asked.items()]))
    return entries(spark, d).select("slug", F.explode(met).alias("question"))


@query(f"""
WITH e AS (SELECT * FROM {ENTRIES_SQL}),
v AS (SELECT 'type' AS facet, type AS value FROM e UNION ALL SELECT 'stage', unnest(stages) FROM e UNION ALL SELECT 'location', unnest(places) FROM e UNION ALL SELECT 'lead', lead FROM e WHERE kind = 'firm'
  UNION ALL SELECT 'active', CASE WHEN status = 'inactive' THEN 'inactive' ELSE active END FROM e WHERE kind = 'firm' UNION ALL SELECT 'scope', scope FROM e UNION ALL SELECT 'kind', kind FROM e),
c AS (SELECT facet, value, count(*)::BIGINT AS count FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'stage' THEN CASE value WHEN 'Pre-seed' THEN 1 WHEN 'Seed' THEN 2 ELSE 3 END ELSE 0 END, count DESC, value)::INTEGER AS rank FROM c
""")
def investor_facets(spark: SparkSession, d: str) -> DataFrame:
    return I.facets(entries(spark, d), ("Pre-seed", "Seed", "Series A"))


@query("""
WITH e AS (SELECT 's-' || s_suppkey AS slug, s_name AS name, s_suppkey % 9 AS p, CASE WHEN s_suppkey % 4 <> 0 THEN 'n' || s_nationkey END AS l FROM supplier),
a AS (SELECT 'portfolio' AS sort, slug, row_number() OVER (ORDER BY p DESC, lower(name), slug) AS place FROM e UNION ALL
  SELECT 'location', slug, row_number() OVER (ORDER BY l NULLS LAST, lower(name), slug) FROM e UNION ALL SELECT 'name_desc', slug, row_number() OVER (ORDER BY lower(name) DESC, slug) FROM e)
SELECT sort, slug, place::INTEGER AS place FROM a WHERE place BETWEEN 3 AND 12
""")
def investor_orders(spark: SparkSession, d: str) -> DataFrame:
    pages = [I.ordered_page(entries(spark, d), s, 2, 10).select(F.lit(s).alias("sort"), "slug", "place") for s in ("portfolio", "location", "name_desc")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("""
WITH n AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')
SELECT n.l_suppkey AS investor_id, count(*)::BIGINT AS links, count(*) FILTER (WHERE b.l_partkey IS NULL)::BIGINT AS unsourced
FROM n JOIN supplier ON s_suppkey = n.l_suppkey AND s_acctbal > 0 LEFT JOIN b ON b.l_partkey = n.l_partkey AND b.l_suppkey = n.l_suppkey GROUP BY 1
""")
def relationship_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parts name their suppliers; a line item that was neither returned nor accepted back is the investment behind it."""
    li = table(spark, d, "lineitem")
    companies = li.groupBy(F.col("l_partkey").alias("company_id")).agg(F.collect_set("l_suppkey").alias("investor_ids"))
    status = lambda c: F.when(c, "verified").otherwise("rejected").alias("status")
    orgs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("investor_id"), status(F.col("s_acctbal") > 0))
    rows = li.select(F.col("l_partkey").alias("company_id"), F.col("l_suppkey").alias("investor_id"), status(F.col("l_returnflag") == "N"))
    return I.relationship_gaps(companies, orgs, rows)


@query("""
WITH s AS (SELECT s_suppkey AS subject_id, unnest([{'f': 'city', 'v': 'n' || s_nationkey}, {'f': 'stages', 'v': 'Seed'}, {'f': 'stages', 'v': 'Series ' || chr(65 + (s_suppkey % 3)::INTEGER)}, {'f': 'thesis', 'v': CASE WHEN s_suppkey % 2 = 0 THEN 'deep' END}]) AS x FROM supplier),
r AS (SELECT DISTINCT l_suppkey AS subject_id, CASE l_linenumber % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'stages' ELSE 'thesis' END AS f, CASE l_linenumber % 3 WHEN 0 THEN 'n' || (l_partkey % 25) WHEN 1 THEN 'series ' || chr(97 + (l_partkey % 3)::INTEGER) ELSE 'deep' END AS k
  FROM lineitem WHERE l_returnflag <> 'R')
SELECT s.subject_id, x.f AS field, x.v AS value FROM s LEFT JOIN r ON r.subject_id = s.subject_id AND r.f = x.f AND r.k = lower(x.v) WHERE x.v IS NOT NULL AND r.k IS NULL
""")
def claims_without_records(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("l_linenumber") % 3
    subjects = table(spark, d, "supplier").select(
        k.alias("subject_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("city"), F.when(k % 2 == 0, "deep").alias("thesis"), F.array(F.lit("Seed"), F.concat(F.lit("Series "), _pick(("A", "B", "C"), k))).alias("stages")
    )
    value = F.when(n == 0, F.concat(F.lit("n"), (F.col("l_partkey") % 25).cast("string"))).when(n == 1, F.concat(F.lit("Series  "), _pick(("a", "b", "c"), F.col("l_partkey")))).otherwise("DEEP ")
    records = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.when(n == 0, "city").when(n == 1, "stages").otherwise("thesis").alias("field"), value.alias("value"), F.when(F.col("l_returnflag") == "R", "superseded").otherwise("active").alias("status")
    )
    return I.claims_without_records(subjects, records, ("city", "thesis"), ("stages",), text_key)
