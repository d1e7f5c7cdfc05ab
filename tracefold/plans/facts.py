"""Facts and postings of pages that carry structured data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import facts
from tracefold.plans.base import query
from tracefold.session import table


def described(spark: SparkSession, d: str) -> DataFrame:
    """The pages, each with a block of structured data about its host: a graph in a list in a graph, and a posting beside it."""
    p = table(spark, d, "pages").withColumn("host", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1)))
    k = F.col("page_id")
    name = F.initcap(F.element_at(F.split("host", r"\."), 1))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    org = say('{"@type": ["Organization", "Brand"], "name": "', name, '", "legalName": "', name, ' Pty Ltd", "foundingDate": "', 1990 + k % 30, '-05-01", "founder": [{"name": "Ada Lovelace"}, "Solo", "Grace Hopper"], '
              '"address": {"streetAddress": "1 High St", "addressLocality": "Perth", "addressRegion": "', F.when(k % 3 == 0, "WA").otherwise("XX"), '", "postalCode": 6000}}')  # fmt: skip
    job = say('{"@type": "JobPosting", "title": "', F.when(k % 4 == 0, " ").otherwise("Engineer "), '", "hiringOrganization": {"name": "', F.when(k % 5 == 0, "Somebody Quite Else").otherwise(name), '"}, "datePosted": "2024-02-', F.lpad((k % 28 + 1).cast("string"), 2, "0"), 'T00:00:00Z", '
              '"jobLocationType": "', F.when(k % 2 == 0, "TELECOMMUTE").otherwise("onsite"), '"}')  # fmt: skip
    block = say('<script async type = "application/ld+json">\n[{"@graph": [', org, ', [{"@graph": {"@graph": [[[[[', job, "]]]]]}}]]}, 7, null]</script><script type='application/ld+json'>{broken</script>")
    return p.withColumn("html", F.concat(F.regexp_replace("html", "</body>\\s*</html>\\s*$", ""), block))


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, page_id % 3 = 0 AS wa FROM pages),
n AS (SELECT *, upper(string_split(host, '.')[1][1:1]) || lower(string_split(host, '.')[1][2:]) AS name FROM p),
f AS (
  SELECT page_id, host, 'name' AS field, name AS value, 'high' AS confidence FROM n
  UNION ALL SELECT page_id, host, 'legal_name', name || ' Pty Ltd', 'high' FROM n
  UNION ALL SELECT page_id, host, 'founded_year', (1990 + page_id % 30)::VARCHAR, 'high' FROM n
  UNION ALL SELECT page_id, host, 'founders', unnest(['Ada Lovelace', 'Grace Hopper']), 'medium' FROM n
  UNION ALL SELECT page_id, host, 'address', '1 High St, Perth WA 6000', 'high' FROM n WHERE wa
  UNION ALL SELECT page_id, host, 'state', 'WA', 'high' FROM n WHERE wa)
SELECT host AS site, field, value, min(confidence) AS confidence, min(page_id) AS page, count(DISTINCT page_id)::BIGINT AS pages FROM f GROUP BY host, field, value
""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    """The strongest reading of each value that the structured data of a site states."""
    pages = described(spark, d)
    found = facts.organisation_facts(facts.nodes(pages)).join(pages.select(F.col("page_id").alias("page"), F.col("host").alias("site")), "page")
    return facts.strongest(found, ["site"], ["page", "pos"]).select("site", "field", "value", "confidence", "page", "pages")


@query("""
WITH p AS (SELECT page_id, url FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0)
SELECT page_id AS page, 'Engineer' AS title, CASE WHEN page_id % 2 = 0 THEN 'Remote' END AS location, '2024-02-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS posted_at, url AS apply_url FROM p
""")
def job_postings(spark: SparkSession, d: str) -> DataFrame:
    pages = described(spark, d)
    name = pages.select(F.col("page_id").alias("page"), F.initcap(F.element_at(F.split("host", r"\."), 1)).alias("name"))
    return facts.job_postings(facts.nodes(pages), pages.select(F.col("page_id").alias("page"), "url"), name).select("page", "title", "location", "posted_at", "apply_url")


@query()
def site_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pages of a host are about the company of the label before its domain; tests hold the operator against the rules one by one."""
    pages = described(spark, d)
    found = facts.page_facts(pages, fields=facts.VERDICT_FIELDS).join(pages.select(F.col("page_id").alias("page"), F.col("host").alias("site")), "page")
    label = F.element_at(F.split("site", r"\."), -3)
    sites = pages.groupBy(F.col("host").alias("site")).agg(F.min("page_id").alias("home")).withColumn("name", label)
    return facts.site_verdicts(found, sites)
