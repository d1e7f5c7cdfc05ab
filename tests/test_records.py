from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracefold.functions import addresses as A
from tracefold.operators import imports, records
from tracefold.sources import robots

NOW = datetime(2026, 10, 5)


def test_slugs_never_collide(spark):
    df = spark.createDataFrame([(0, "Acme"), (1, "acme"), (2, "Acme-2"), (3, "ACME"), (4, "!!"), (5, "Crème"), (6, "creme")], "pos int, name string")
    got = {r.pos: r.slug for r in records.unique_slugs(df, "name", "pos").collect()}
    assert got == {0: "acme", 1: "acme-3", 2: "acme-2", 3: "acme-4", 4: "item", 5: "creme", 6: "creme-2"}


def test_public_hides_what_is_vague(spark):
    df = spark.createDataFrame([("EXACT", 1.0, 2.0, 0.5), ("CITY", 1.0, 2.0, 0.5)], "location_precision string, lat double, lng double, confidence_score double")
    out = records.public(df)
    assert "confidence_score" not in out.columns and [r.lat for r in out.collect()] == [1.0, None]


def test_migration_is_idempotent(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, slug string")
    derive = {"slug": F.concat(F.lit("s"), F.col("id").cast("string")), "country": F.lit("Australia")}
    once = records.fill_missing(df, derive)
    assert once.collect() == records.fill_missing(once, derive).collect() and [r.slug for r in once.collect()] == ["s1", "x"]


def test_hiring_states(spark):
    rows = [(True, None, NOW, None), (True, None, NOW - timedelta(days=20), None), (False, "not_hiring", None, NOW), (None, None, None, None)]
    df = spark.createDataFrame(rows, "h boolean, s string, c timestamp, n timestamp")
    state = lambda days: [r.x for r in df.select(records.hiring_state(F.col("h"), F.col("s"), F.col("c"), F.col("n"), F.lit(NOW), days).alias("x")).collect()]
    assert state(14) == ["hiring", "checked", "none", "unverified"] and state(None) == ["hiring", "hiring", "none", "unverified"]


def test_moving_fields_take_the_new_value_on_a_tie(spark):
    s = spark.createDataFrame([("a", "hiring_status", "no", 2), ("a", "city", "Perth", 2)], "id string, field string, value string, confidence int")
    f = spark.createDataFrame([("a", "hiring_status", "yes", 2), ("a", "city", "Sydney", 2)], "id string, field string, value string, confidence int")
    got = {r.field: (r.value, r.action) for r in records.merge_claims(s, f, ["id", "field"], ["hiring_status"]).collect()}
    assert got == {"hiring_status": ("yes", "replaced"), "city": ("Perth", "conflict")}


def test_people_import(spark):
    firms = spark.createDataFrame([("f1", "a.vc", "alpha"), ("f2", "b.vc", "beta"), ("f3", None, "beta")], "id string, domain string, name string")
    people = spark.createDataFrame([("p1", "in/ann", "ann lee", "f1"), ("p2", None, "bo ray", "f2")], "id string, profile string, name string, firm_id string")
    rows = spark.createDataFrame(
        [(1, "ann lee", "in/ann", "a.vc", "alpha"), (2, "ann lee", "in/ann", "b.vc", "x"), (3, "bo ray", None, "b.vc", None), (4, "cy", None, None, "beta"), (5, "di", None, "zz.vc", "gamma"), (6, "ed", None, None, "alpha")],
        "id int, person string, profile string, firm_domain string, firm_name string",
    )
    got = {r.id: (r.firm_id, r.person_id, r.action) for r in imports.plan_people(rows, firms, people).collect()}
    assert got == {1: ("f1", "p1", "link"), 2: ("f2", "p1", "other_firm"), 3: ("f2", "p2", "link"), 4: (None, None, "ambiguous_firm"), 5: (None, None, "unknown_firm"), 6: ("f1", None, "add")}


def test_funding_stories(spark):
    stories = spark.createDataFrame(
        [("s1", NOW, "Seed", ["x"], None), ("s2", NOW, "Seed", ["q"], "perth"), ("s3", NOW, None, ["x"], None), ("s4", NOW - timedelta(days=200), "Seed", ["x"], None), ("s5", NOW, "Seed", ["x"], None), ("s6", NOW, "Seed", ["q"], None)],
        "id string, at timestamp, round string, investors array<string>, city string",
    )
    matches = spark.createDataFrame([(s, "c1", "EXACT_MATCH") for s in ("s1", "s2", "s3", "s4", "s5", "s6")] + [("s5", "c2", "LIKELY_MATCH"), ("s1", "c2", "POSSIBLE_MATCH")], "story_id string, company_id string, outcome string")
    companies = spark.createDataFrame([("c1", ["x", "y"], "perth"), ("c2", [], None)], "id string, investors array<string>, city string")
    got = {(r.story_id, r.company_id) for r in imports.attach_funding(stories, matches, companies, F.lit(NOW)).collect()}
    assert got == {("s1", "c1"), ("s2", "c1")}


def test_addresses(spark):
    rows = [
        ("Level 7, 127 Creek St, Brisbane QLD 4000", "127 Creek Street Brisbane 4000", "127 creek street", "4000", "QLD", True),
        ("Suite 1.103/477 Pitt St Sydney NSW 2000", "477 Pitt St, Haymarket 2000", "477 pitt street", "2000", "NSW", True),
        ("8/4 Martin Place", "4 Martin Pl, Sydney", "4 martin place", None, None, True),
        ("West Perth 6005, WA", "Subiaco 6008", None, "6005", "WA", False),
        ("Sydney", " sydney", None, None, None, True),
        ("1 High St, 2000", "1 High St, 3000", "1 high street", "2000", None, False),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(A.street(a), A.postcode(a), A.state(a), A.same(a, b)).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: *\nDisallow: /*.pdf$ # no\nDisallow:\nCrawl-delay: 5"
    t = robots.rules(spark.createDataFrame([("h", body)], "host string, body string"))
    assert {(r.agent, r.kind, r.path) for r in t.collect()} == {("a", "disallow", "/x"), ("b", "disallow", "/x"), ("a", "allow", "/x/ok"), ("b", "allow", "/x/ok"), ("*", "disallow", "/*.pdf$"), ("*", "crawl-delay", "5")}
    u = spark.createDataFrame([("h", "/x/1"), ("h", "/x/ok/2"), ("h", "/a.pdf"), ("h", "/a.pdf?x"), ("z", "/x")], "host string, path string")
    ok = lambda agent: {r.path: r.allowed for r in robots.allowed(u.where("host = 'h'"), t, agent).collect()}
    assert ok("B") == {"/x/1": False, "/x/ok/2": True, "/a.pdf": True, "/a.pdf?x": True}
    assert ok("other") == {"/x/1": True, "/x/ok/2": True, "/a.pdf": False, "/a.pdf?x": True}
    assert robots.allowed(u, t, "a").where("host = 'z'").first().allowed
