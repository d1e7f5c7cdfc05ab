from datetime import datetime

from tracefold.operators import validate as V


def found(df):
    return sorted((r.id, r.code) for r in df.collect())


T = datetime(2024, 1, 2)
HISTORY = "status_history array<struct<status:string,at:timestamp,by:string>>"
CANDIDATE = f"id string, name string, status string, website string, domain string, state string, abn string, acn string, resolution string, discoveries array<struct<source_id:string,source_kind:string,key:string,observed_at:timestamp>>, first_discovered_at timestamp, last_seen_at timestamp, published_company_id string, {HISTORY}"


def candidate(i="cand-a", status="candidate", steps=("candidate",), **over):
    row = dict(id=i, name="A", status=status, website="https://www.acme.com.au/x", domain="acme.com.au", state="NSW", abn="51824753556", acn=None, resolution="NEW_COMPANY", discoveries=[("s", "press", "k", T)], first_discovered_at=T, last_seen_at=T, published_company_id=None, status_history=[(s, T, "engine") for s in steps])
    return tuple((row | over).values())


def test_candidates(spark):
    companies = spark.createDataFrame([("c1",)], "id string")
    good = [candidate(), candidate("cand-b", "published", ("candidate", "needs_review", "approved", "published"), published_company_id="c1"), candidate("cand-c", website=None, domain=None)]
    assert found(V.candidates(spark.createDataFrame(good, CANDIDATE), companies)) == []
    bad = [
        candidate("x", name=" "), candidate("cand-1", "approved", ("candidate", "approved")), candidate("cand-2", "matched", ("needs_review", "matched")), candidate("cand-3", status="matched"),
        candidate("cand-4", domain="www.acme.com.au"), candidate("cand-5", abn="1", state="XX"), candidate("cand-6", discoveries=[]), candidate("cand-7", discoveries=[("s", "odd", "k", T)]), candidate("cand-8", last_seen_at=datetime(2023, 1, 1)),
        candidate("cand-9", "published", ("candidate", "needs_review", "approved", "published"), published_company_id="gone"), candidate("cand-10", status_history=[]), candidate("cand-11", status_history=[("candidate", None, "x")]),
        candidate("cand-12", "published", ("candidate", "needs_review", "approved", "published")), candidate("cand-13"), candidate("cand-13"),
    ]
    assert found(V.candidates(spark.createDataFrame(bad, CANDIDATE), companies)) == sorted([
        ("x", "id"), ("x", "name"), ("cand-1", "history_step"), ("cand-2", "history_begins"), ("cand-3", "history_ends"), ("cand-4", "domain"), ("cand-5", "abn"), ("cand-5", "state"), ("cand-6", "no_discovery"), ("cand-7", "discovery"),
        ("cand-8", "seen_before_discovered"), ("cand-9", "no_published_company_id"), ("cand-10", "no_history"), ("cand-11", "history_says"), ("cand-12", "published_without_company"), ("cand-13", "not_unique"),
    ])


def test_tasks(spark):
    ddl = "id string, kind string, target_id string, status string, attempts int, lease_until timestamp, created_at timestamp, finished_at timestamp, not_before timestamp"
    rows = [
        ("a", "company", "c1", "queued", 0, None, T, None, T), ("b", "company", "c1", "running", 1, T, T, None, None), ("c", "company", "c2", "done", 1, None, T, T, None),
        ("d", "company", "c2", "running", -1, None, T, None, None), ("e", "site", "c2", "done", 0, T, T, None, T), ("f", "company", "c2", "odd", None, None, T, datetime(2023, 1, 1), None), ("f", "company", None, "cancelled", 0, None, T, T, None),
    ]
    targets = spark.createDataFrame([("company", "c1"), ("company", "c2")], "kind string, id string")
    assert found(V.tasks(spark.createDataFrame(rows, ddl), targets)) == sorted([
        ("a", "two_active"), ("d", "attempts"), ("d", "running_without_lease"), ("e", "finished_at"), ("e", "lease_without_running"), ("e", "waits_without_queue"), ("e", "no_target_id"), ("f", "attempts"), ("f", "finished_before_created"), ("f", "not_unique"), ("f", "status"),
    ])


def test_locations(spark):
    ddl = "id string, company_id string, kind string, precision string, address string, city string, lat double, lng double"
    heads = spark.createDataFrame([("c1", "EXACT", "1 High St", "Perth", 1.0, 2.0), ("c2", "CITY", None, "Perth", None, None)], "company_id string, precision string, address string, city string, lat double, lng double")
    rows = [
        ("a", "c1", "HEADQUARTERS", "EXACT", "1 High St", "Perth", 1.0, 2.0), ("b", "c1", "OFFICE", "SUBURB", None, "Perth", 1.0, 3.0), ("c", "c2", "HEADQUARTERS", "CITY", None, "Hobart", None, None), ("d", "c2", "HEADQUARTERS", "CITY", None, "Perth", None, None),
        ("e", "c1", "OFFICE", "UNKNOWN", None, None, None, 1.0), ("f", "c9", "SHED", "EXACT", " ", None, None, None), ("g", "c1", "OFFICE", "CITY", None, None, None, None),
    ]
    assert found(V.location_rows(spark.createDataFrame(rows, ddl), heads)) == sorted([
        ("c", "differs_from_company"), ("c", "two_headquarters"), ("e", "half_a_point"), ("e", "office_without_place"), ("f", "kind"), ("f", "no_point"), ("f", "exact_without_address"), ("f", "no_company_id"), ("g", "city_without_city"),
    ])


def test_trail(spark):
    ddl = "pos long, id string, at timestamp, actor string, role string, action string, target_type string, target_id string, summary string"
    h = lambda m: datetime(2024, 1, 1, 5, m)
    rows = [(1, "aud-1-1", h(30), "ann", "admin", "go", "c", "1", "s"), (2, "aud-1-2", h(25), "ann", "admin", "go", "c", "1", "s"), (3, "aud-1-3", h(5), "ann", "admin", "go", "c", "1", "s"), (4, "x", None, " ", "boss", "stop", "", "1", None), (5, "aud-1-5", h(1), "a" * 81, "admin", "go", "c", "1", "s")]
    assert found(V.audit_trail(spark.createDataFrame(rows, ddl), ("go",), ("admin",))) == sorted([("aud-1-3", "out_of_order"), ("x", "id"), ("x", "at"), ("x", "actor"), ("x", "role"), ("x", "action"), ("x", "target"), ("x", "summary"), ("aud-1-5", "actor")])
