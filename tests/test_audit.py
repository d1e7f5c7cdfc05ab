"""Audit and rules: rows of nulls, empty tables, and addresses that are nobody's own site."""

from datetime import datetime

from pyspark.sql import functions as F

from tracefold.operators import audit as A
from tracefold.operators import validate as V

COMPANY = """id string, name string, website string, sector string, city string, state string, address string, lat double, lng double, location_precision string, verified boolean, stage string,
company_status string, hiring boolean, description string, founders array<string>, founded_year int, funding_total double, last_funding_round string, last_funding_date string, investors array<string>,
source_ids array<string>, last_verified_at string"""


def test_a_row_of_nulls_is_audited(spark):
    c = spark.createDataFrame([("a", *[None] * 22)], COMPANY)
    none = spark.createDataFrame([], "company_id string")
    found = A.facts(spark.createDataFrame([], "company_id string, field string, verified_at timestamp"), none, none, none, none, none)
    rows = A.audited(c, found, datetime(2026, 1, 1)).collect()
    assert len(rows) == 1 and rows[0].tier == 1
    assert {t.code for t in rows[0].tasks} == {
        "missing_website", "unconfirmed_location", "unknown_sector", "missing_description", "unknown_stage", "missing_funding", "missing_founders", "missing_investors", "missing_founded_year", "no_source",
    }
    assert A.audited(c.limit(0), found, datetime(2026, 1, 1)).count() == 0


def test_website_problems(spark):
    cases = {
        "https://airwallex.com": [], "https://www.x.com/a": ["not_its_own_site"], "https://apps.apple.com/au": ["not_its_own_site"], "acme.com/a": ["no_scheme"], "acme": ["not_an_address"],
        "ftp://acme.com": ["scheme"], "http://localhost/": ["not_a_public_host"], "http://10.0.0.1/": ["not_a_public_host"], "https://acme.com/a b": ["whitespace"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.p for r in df.select("url", A.website_problems(F.col("url")).alias("p")).collect()} == cases


def test_rules_leave_out_columns_that_a_table_lacks(spark):
    df = spark.createDataFrame([("s-1", "press"), ("S 2", "gossip"), (None, None)], "id string, kind string")
    assert sorted((r.id or "", r.code) for r in V.broken("sources", df, V.SOURCE_RULES).collect()) == [("", "id"), ("", "kind"), ("S 2", "id"), ("S 2", "kind")]
