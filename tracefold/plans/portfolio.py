"""Portfolios, teams, marks, reviews of investors; places and short texts. Suppliers stand for firms, parts for companies, customers for people."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import texts
from tracefold.operators import locations as L
from tracefold.operators import portfolio as P
from tracefold.plans.base import query
from tracefold.session import table
from tracefold.sources import licences

AS_OF = datetime(2001, 8, 1)
FIRMS_SQL = "(SELECT s_suppkey AS id, 's-' || s_suppkey AS slug, CASE WHEN s_suppkey % 7 = 0 THEN 'inactive' WHEN s_acctbal > 2000 THEN 'published' ELSE 'verified' END AS status FROM supplier)"
PEOPLE_SQL = "(SELECT c_custkey AS id, c_custkey % 10 + 1 AS firm_id, 'p-' || c_custkey AS slug, CASE WHEN c_acctbal > 1000 THEN 'published' ELSE 'verified' END AS status FROM customer)"


def _slug(prefix: str, k):
    return F.concat(F.lit(prefix), k.cast("string"))


def firms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(k % 7 == 0, "inactive").when(F.col("s_acctbal") > 2000, "published").otherwise("verified")
    return table(spark, d, "supplier").select(k.alias("id"), _slug("s-", k).alias("slug"), status.alias("status"))


def people(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k % 10 + 1).alias("firm_id"), _slug("p-", k).alias("slug"), F.when(F.col("c_acctbal") > 1000, "published").otherwise("verified").alias("status"))


@query(f"""
WITH f AS (SELECT * FROM {FIRMS_SQL} WHERE status IN ('published', 'inactive')), p AS (SELECT * FROM {PEOPLE_SQL} WHERE status = 'published' AND firm_id IN (SELECT id FROM f)),
u AS (SELECT s_suppkey AS id, 'f-' || s_suppkey AS slug FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey IN (SELECT id FROM f))
SELECT f.slug AS firm, 'c-' || p_partkey AS company, l_shipdate AS invested_on, u.slug AS fund, p.slug AS person, 'https://o' || o_orderkey || '.example' AS url
FROM lineitem JOIN f ON f.id = l_suppkey JOIN part ON p_partkey = l_partkey AND p_size > 5 JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'
LEFT JOIN u ON u.id = CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END LEFT JOIN p ON p.id = l_orderkey % 200 WHERE l_returnflag = 'N'
""")
def investor_portfolio(spark: SparkSession, d: str) -> DataFrame:
    li, k = table(spark, d, "lineitem"), F.col("s_suppkey")
    rows = li.select(
        F.col("l_suppkey").alias("firm_id"), F.col("l_partkey").alias("company_id"), F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("fund_id"),
        (F.col("l_orderkey") % 200).alias("person_id"), F.when(F.col("l_returnflag") == "N", "verified").otherwise("unverified").alias("status"), F.col("l_shipdate").alias("invested_on"),
    )
    companies = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), _slug("c-", F.col("p_partkey")).alias("slug"))
    key = F.col("o_orderkey")
    sources = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(key.alias("id"), F.concat(F.lit("https://o"), key.cast("string"), F.lit(".example")).alias("url"))
    funds = table(spark, d, "supplier").select(k.alias("id"), k.alias("firm_id"), _slug("f-", k).alias("slug"), F.when(k % 2 == 0, "published").otherwise("verified").alias("status"))
    return P.portfolio(rows, firms(spark, d), companies, sources, funds, people(spark, d))


@query(f"""
WITH f AS (SELECT * FROM {FIRMS_SQL} WHERE status IN ('published', 'inactive')), p AS (SELECT * FROM {PEOPLE_SQL} WHERE status = 'published' AND firm_id IN (SELECT id FROM f))
SELECT f.slug AS firm, p.slug AS person, o_orderpriority AS role, o_orderstatus = 'O' AS is_current, 'https://o' || o_orderkey || '.example' AS url
FROM orders JOIN f ON f.id = o_orderkey % 10 + 1 JOIN p ON p.id = o_custkey WHERE o_orderkey % 5 <> 0 AND o_totalprice > 1000
""")
def investor_team(spark: SparkSession, d: str) -> DataFrame:
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = orders.select(
        (k % 10 + 1).alias("firm_id"), F.col("o_custkey").alias("person_id"), k.alias("source_id"), F.col("o_orderpriority").alias("role"),
        F.when(F.col("o_orderstatus") == "O", True).alias("is_current"), F.when(F.col("o_totalprice") > 1000, "verified").otherwise("rejected").alias("status"),
    )
    sources = orders.where(k % 5 != 0).select(k.alias("id"), F.concat(F.lit("https://o"), k.cast("string"), F.lit(".example")).alias("url"))
    return P.team(rows, people(spark, d), firms(spark, d), sources)


@query("""
WITH p AS (SELECT c_custkey, c_custkey % 10 + 1 AS f, CASE WHEN c_custkey % 3 = 0 THEN 'Seed' END AS st, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS se FROM customer),
f AS (SELECT s_suppkey AS f, CASE WHEN s_suppkey % 2 = 0 THEN 'Series A' END AS fst, CASE WHEN s_suppkey % 4 = 0 THEN 'Fintech' END AS fse FROM supplier)
SELECT c_custkey, coalesce(st, fst, '') AS stages, coalesce(se, fse, '') AS sectors, CASE WHEN st IS NOT NULL OR se IS NOT NULL THEN 'person' WHEN fst IS NOT NULL OR fse IS NOT NULL THEN 'firm' END AS focus_from
FROM p LEFT JOIN f USING (f)
""")
def people_focus(spark: SparkSession, d: str) -> DataFrame:
    some = lambda when, v: F.array_compact(F.array(F.when(when, v)))
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    who = table(spark, d, "customer").select("c_custkey", (k % 10 + 1).alias("firm_id"), some(k % 3 == 0, F.lit("Seed")).alias("stage_focus"), some(k % 5 == 0, F.col("c_mktsegment")).alias("sector_focus"))
    at = table(spark, d, "supplier").select(s.alias("id"), some(s % 2 == 0, F.lit("Series A")).alias("stages"), some(s % 4 == 0, F.lit("Fintech")).alias("sectors"))
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c)
    return P.with_focus(who, at).select("c_custkey", text("stages"), text("sectors"), "focus_from")


@query("""
WITH c(i, city, state, lat, lng) AS (VALUES (0, 'Sydney', 'NSW', -33.8688, 151.2093), (1, 'Melbourne', 'VIC', -37.8136, 144.9631), (2, 'Perth', 'WA', -31.9523, 115.8613), (3, 'Cairns', 'QLD', -16.9186, 145.7781)),
s AS (SELECT 's-' || s_suppkey AS slug, s_suppkey AS k, s_nationkey % 5 AS h, [s_suppkey % 4, (s_suppkey + 1) % 4] AS o FROM supplier),
a AS (SELECT slug, k, h AS i, 0 AS t FROM s UNION ALL SELECT slug, k, unnest(o), 1 FROM s), n AS (SELECT slug, k, i, min(t) AS t FROM a GROUP BY ALL)
SELECT slug, city, state, CASE t WHEN 0 THEN 'headquarters' ELSE 'office' END AS role, CASE WHEN i = 1 AND k % 2 = 0 THEN 'EXACT' ELSE 'CITY' END AS precision,
  CASE WHEN i = 1 AND k % 2 = 0 THEN k || ' Collins St' END AS address, CASE WHEN i = 1 AND k % 2 = 0 THEN -37.5 ELSE lat END::DOUBLE AS lat, CASE WHEN i = 1 AND k % 2 = 0 THEN 144.5 ELSE lng END::DOUBLE AS lng FROM n JOIN c USING (i)
""")
def investor_pins(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    city = lambda i: F.element_at(F.array(*map(F.lit, ("Sydney", "MELBOURNE", "perth", "Cairns", "Nowhere"))), (i + 1).cast("int"))
    rows = table(spark, d, "supplier").select(_slug("s-", k).alias("slug"), city(F.col("s_nationkey") % 5).alias("city"), F.array(city(k % 4), city((k + 1) % 4)).alias("offices"))
    placed = table(spark, d, "supplier").where(k % 2 == 0).select(_slug("s-", k).alias("slug"), F.lit("Melbourne").alias("city"), F.concat(k.cast("string"), F.lit(" Collins St")).alias("address"), F.lit(-37.5).alias("lat"), F.lit(144.5).alias("lng"))
    return P.pins(rows, placed)


NAMED_SQL = """(SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 = 0 THEN 'rejected' WHEN s_suppkey % 5 = 0 THEN 'candidate' WHEN s_suppkey % 5 = 1 THEN 'needs_review' ELSE 'published' END AS status,
  CASE s_suppkey % 6 WHEN 0 THEN 'Blue Cafe ' || s_suppkey // 6 WHEN 1 THEN 'blue  café-' || s_suppkey // 6 WHEN 2 THEN 'Blue Cafe ' || s_suppkey // 6 || ' etc.' WHEN 3 THEN 'A' || s_suppkey WHEN 4 THEN 'A' || (s_suppkey - 1) || ' Partners' ELSE 'Blue Cafe ' || s_suppkey // 6 || ' & Sons' END AS name,
  CASE WHEN s_suppkey % 9 = 0 THEN 'd' || s_suppkey // 27 || '.com' END AS domain FROM supplier)"""
DUPLICATES_SQL = f"""(WITH n AS (SELECT id, name, domain, regexp_matches(name, 'etc\\.') AS compound, trim(regexp_replace(replace(lower(strip_accents(name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS k FROM {NAMED_SQL} WHERE status <> 'rejected'),
  b AS (SELECT a.id AS a, b.id AS b, a.k AS k FROM n a JOIN n b ON starts_with(b.k, a.k || ' ') AND (b.compound OR length(a.k) >= 4))
  SELECT id, 'name' AS reason, k AS key FROM n QUALIFY count(*) OVER (PARTITION BY k) > 1 UNION SELECT id, 'website', domain FROM n WHERE domain IS NOT NULL QUALIFY count(*) OVER (PARTITION BY domain) > 1
  UNION SELECT a, 'beginning', k FROM b UNION SELECT b, 'beginning', k FROM b)"""


def named_firms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = (k / 6).cast("long").cast("string")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("Blue Cafe "), n)).when(k % 6 == 1, F.concat(F.lit("blue  café-"), n)).when(k % 6 == 2, F.concat(F.lit("Blue Cafe "), n, F.lit(" etc.")))
        .when(k % 6 == 3, _slug("A", k)).when(k % 6 == 4, F.concat(_slug("A", k - 1), F.lit(" Partners"))).otherwise(F.concat(F.lit("Blue Cafe "), n, F.lit(" & Sons")))
    )
    return table(spark, d, "supplier").select(
        k.alias("id"), name.alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.when(k % 9 == 0, F.concat(F.lit("https://www.d"), (k / 27).cast("long").cast("string"), F.lit(".com/x"))).alias("website"),
        F.when(k % 17 == 0, "rejected").when(k % 5 == 0, "candidate").when(k % 5 == 1, "needs_review").otherwise("published").alias("status"),
    )


@query(f"SELECT * FROM {DUPLICATES_SQL}")
def duplicate_firms(spark: SparkSession, d: str) -> DataFrame:
    return P.possible_duplicate_firms(named_firms(spark, d))


@query(f"""
WITH f AS (SELECT id, status, name, domain, s_acctbal AS b, s_nationkey AS n FROM {NAMED_SQL} JOIN supplier ON s_suppkey = id WHERE status <> 'rejected'), du AS (SELECT DISTINCT id FROM {DUPLICATES_SQL}),
g AS (SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1),
i AS (SELECT id, list_filter([CASE WHEN status = 'needs_review' THEN 'needs_review' END, CASE WHEN id % 8 = 0 THEN 'evidence_conflict' END, CASE WHEN id IN (SELECT id FROM du) THEN 'possible_duplicate_firm' END], lambda x: x IS NOT NULL) AS hi,
  list_filter([CASE WHEN status = 'candidate' THEN 'new_candidate' END, CASE WHEN name LIKE '%etc.%' THEN 'compound_name' END, CASE WHEN status = 'published' AND (id % 4 = 0 OR id % 4 = 1) THEN 'stale_verification' END, CASE WHEN id % 10 = 3 THEN 'unsourced_claims' END], lambda x: x IS NOT NULL) AS me,
  list_filter([CASE WHEN id % 3 = 0 THEN 'missing_type' END, CASE WHEN n % 2 = 0 AND b <= 0 THEN 'missing_location' END, CASE WHEN id % 2 = 0 THEN 'missing_stages' END, CASE WHEN id % 7 <> 0 THEN 'missing_sectors' END, CASE WHEN domain IS NULL THEN 'missing_website' END,
    CASE WHEN id IN (SELECT id FROM g) THEN 'unverified_relationships' END], lambda x: x IS NOT NULL) AS lo FROM f)
SELECT id, array_to_string(hi || me || lo, ',') AS issues, CASE WHEN len(hi) > 0 THEN 'high' WHEN len(me) > 0 THEN 'medium' ELSE 'low' END AS worst FROM i WHERE len(hi || me || lo) > 0
""")
def investor_review(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    none, named = F.array().cast("array<string>"), named_firms(spark, d)
    more = table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 3 != 0, "vc").alias("type"), F.when(F.col("s_nationkey") % 2 == 1, "Sydney").alias("city"), F.when(F.col("s_acctbal") > 0, "Australia").otherwise("").alias("country"),
        F.when(k % 2 == 0, none).otherwise(F.array(F.lit("Seed"))).alias("stages"), F.when(k % 7 == 0, F.array(F.lit("Fintech"))).alias("sectors"),
        F.when(k % 4 == 0, F.lit(datetime(2000, 7, 1))).when(k % 4 > 1, F.lit(datetime(2001, 7, 1))).alias("checked_at"),
    )
    ids = lambda n, r: table(spark, d, "supplier").where(k % n == r).select(k.alias("id"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("unsourced"))
    out = P.review(named.join(more, "id"), P.possible_duplicate_firms(named), ids(8, 0), ids(10, 3), returned, F.lit(AS_OF))
    return out.withColumn("issues", F.array_join("issues", ","))


PLACES_SQL = """(SELECT c_custkey AS k, ['EXACT', 'SUBURB', 'CITY', 'STATE', NULL][(c_custkey % 5 + 1)::INTEGER] AS p, CASE WHEN c_custkey % 3 > 0 THEN c_custkey || ' Pitt St' END AS street,
  CASE WHEN c_custkey % 4 = 0 THEN 'Sydney' WHEN c_custkey % 4 < 3 THEN 'Newtown' END AS suburb, CASE WHEN c_nationkey % 3 > 0 THEN 'Sydney' END AS city, CASE WHEN c_custkey % 7 > 0 THEN 'NSW' END AS state FROM customer)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "EXACT").when(k % 5 == 1, "SUBURB").when(k % 5 == 2, "CITY").when(k % 5 == 3, "STATE").alias("precision"), F.when(k % 3 > 0, F.concat(k.cast("string"), F.lit(" Pitt St"))).alias("street"),
        F.when(k % 4 == 0, "Sydney").when(k % 4 < 3, "Newtown").alias("suburb"), F.when(F.col("c_nationkey") % 3 > 0, "Sydney").otherwise("Unknown").alias("city"), F.when(k % 7 > 0, "NSW").alias("state"),
        F.when(k % 2 == 0, F.lit(AS_OF)).alias("verified_at"), F.lit("2000").alias("postcode"), F.col("c_acctbal").alias("lat"), F.lit(151.0).alias("lng"),
    )


@query(f"""
WITH w AS (SELECT *, concat_ws(', ', city, state) AS w FROM {PLACES_SQL})
SELECT k AS id, CASE p WHEN 'EXACT' THEN coalesce(nullif(concat_ws(', ', street, CASE WHEN suburb IS DISTINCT FROM city THEN suburb END, city), ''), w) WHEN 'SUBURB' THEN coalesce(nullif(concat_ws(', ', suburb, CASE WHEN suburb IS DISTINCT FROM city THEN city END), ''), w)
  WHEN 'CITY' THEN w WHEN 'STATE' THEN state END AS place, CASE p WHEN 'EXACT' THEN CASE WHEN k % 2 = 0 THEN 'Verified office' ELSE 'Office address on file' END WHEN 'SUBURB' THEN 'Location: suburb-level' WHEN 'CITY' THEN 'Exact location not published'
  WHEN 'STATE' THEN 'Location: state-level' ELSE 'Location unknown' END AS quality FROM w
""")
def location_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.described(places(spark, d)).select("id", "place", "quality")


@query(f"SELECT k || '.hq' AS id, k AS company_id, 'HEADQUARTERS' AS kind, CASE WHEN p IS NOT NULL THEN street END AS address, suburb, city, state, '2000' AS postcode, c_acctbal AS latitude, 151.0::DOUBLE AS longitude, coalesce(p, 'UNKNOWN') AS precision FROM {PLACES_SQL} JOIN customer ON c_custkey = k")
def headquarters_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.headquarters(places(spark, d).withColumn("address", F.col("street")))


@query("""
WITH m(i, kind, pts) AS (VALUES (0, 'company_website', 2), (1, 'company_document', 2), (2, 'credible_profile', 1.5), (3, 'manual', 1.5), (4, 'ecosystem_source', 0.5), (5, 'directory', 0), (6, NULL, NULL)),
s AS (SELECT kind, pts + (p_size % 2) + (p_partkey % 3 = 0)::INTEGER AS s FROM part JOIN m ON i = p_partkey % 7)
SELECT kind AS source, CASE WHEN kind IS NULL THEN NULL WHEN s >= 3.5 THEN 'high' WHEN s >= 1.5 THEN 'medium' ELSE 'low' END AS confidence, count(*)::BIGINT AS n FROM s GROUP BY 1, 2
""")
def location_confidence(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("company_website", "company_document", "credible_profile", "manual", "ecosystem_source", "directory", None)])
    rows = table(spark, d, "part").select(F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int")).alias("source"), (F.col("p_size") % 2 == 1).alias("read"), (F.col("p_partkey") % 3 == 0).alias("agrees"))
    return rows.groupBy("source", L.confidence(F.col("source"), F.col("read"), F.col("agrees")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_partkey AS company_id, CASE WHEN l_linenumber % 2 = 0 THEN 'city' ELSE 'address' END AS field, l_linestatus AS value, l_orderkey AS source_id, 'https://o' || o_orderkey || '.example' AS url
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' WHERE l_returnflag = 'A' AND l_linenumber < 4
""")
def location_backing(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("l_linenumber"), F.col("o_orderkey")
    claims = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("company_id"), F.when(n > 3, "stage").when(n % 2 == 0, "city").otherwise("address").alias("field"), F.col("l_linestatus").alias("value"), F.col("l_orderkey").alias("source_id"),
        F.when(F.col("l_returnflag") == "A", "active").otherwise("superseded").alias("status"),
    )
    sources = table(spark, d, "orders").where("o_orderstatus = 'F'").select(k.alias("id"), F.concat(F.lit("https://o"), k.cast("string"), F.lit(".example")).alias("url"))
    return L.backing(claims, sources)


@query("""
WITH e AS (SELECT event_id AS position, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 1 DAY WHEN event_id % 7 = 3 THEN ts - INTERVAL 9 MINUTE ELSE ts END AS "at" FROM events)
SELECT * FROM (SELECT position, "at", lag("at") OVER (ORDER BY position) AS at_before FROM e) WHERE "at" < at_before - INTERVAL 10 MINUTE
""")
def log_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    at = F.when(k % 7 == 0, ts - F.expr("INTERVAL 1 DAY")).when(k % 7 == 3, ts - F.expr("INTERVAL 9 MINUTE")).otherwise(ts)
    return L.out_of_order(table(spark, d, "events").select(k.alias("position"), at.alias("at")))


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:https?://|www\\.)\\S+'))::INTEGER AS links, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{5,}}'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in texts.COMMON)}))))::INTEGER AS words,
  CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS clipped FROM documents
""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", texts.link_count(t).alias("links"), F.size(texts.distinctive_words(t)).alias("words"), texts.clip(t).alias("clipped"))


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'segment:' || c_mktsegment || '>' || lower(c_mktsegment) END, CASE WHEN c_custkey % 3 = 0 THEN 'nation:' || c_nationkey || '>-' END], lambda x: x IS NOT NULL), ' ') AS changed FROM customer
""")
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    k, seg, nation = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey")
    none = F.lit(None).cast("string")
    after = {"segment": F.when(k % 2 == 0, F.lower(seg)).otherwise(seg), "nation": F.when(k % 3 != 0, nation), "note": none}
    rows = texts.changes({"segment": seg, "nation": nation, "note": none}, after)
    line = lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["from"], F.lit("-")), F.lit(">"), F.coalesce(x["to"], F.lit("-")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(rows, line), " ").alias("changed"))


@query("""
WITH b(i, basis, stated) AS (VALUES (0, 'public_feed', false), (1, 'user_submission', false), (2, 'company_website', false), (3, 'open_data', true), (4, 'licensed_api', true), (5, 'permitted_page', true), (6, 'borrowed', NULL), (7, NULL, NULL)),
c AS (SELECT p_partkey AS id, basis, stated, p_size % 3 = 0 AS att, ['https://x/terms', 'ftp://x', NULL][(p_partkey % 3 + 1)::INTEGER] AS u, p_partkey % 5 AS a, p_partkey % 11 = 0 AS off FROM part JOIN b ON i = p_partkey % 8),
p AS (SELECT id, a, off, concat_ws('; ', CASE WHEN stated IS NULL THEN 'basis' END, CASE WHEN stated AND NOT att THEN 'attestation' END, CASE WHEN (stated AND (u IS NULL OR u = 'ftp://x')) OR (NOT stated AND u = 'ftp://x') THEN 'terms_url' END) AS bad FROM c)
SELECT id, CASE WHEN off THEN 'disabled' WHEN a > 2 THEN 'unknown adapter' WHEN bad <> '' THEN 'no valid licence: ' || bad END AS skipped FROM p
""")
def source_licences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    configs = table(spark, d, "part").select(
        k.alias("id"), pick(("rss", "submissions", "structured-feed", "fax", None)).alias("adapter"), F.when(k % 11 == 0, False).alias("enabled"),
        pick(("public_feed", "user_submission", "company_website", "open_data", "licensed_api", "permitted_page", "borrowed", None)).alias("basis"),
        F.when(F.col("p_size") % 3 == 0, "CC BY 4.0").otherwise(" ").alias("attestation"), pick(("https://x/terms", "ftp://x", None)).alias("terms_url"),
    )
    return licences.judged(configs).select("id", "skipped")
