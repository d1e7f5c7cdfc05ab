import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.functions import names as names_of
from tracefold.operators import catalog, evidence, incremental, quality, resolve
from tracefold.plans import resolution
from tracefold.sources import boards, sinks, tables
from tracefold.streaming.reads import ReadTable, sessions, windowed

NOW = datetime(2026, 10, 5, 4)


def test_random_filters_equal_a_plain_filter(spark):
    r = random.Random(4)
    cities, sectors = ["Sydney", "Melbourne", "Glebe", None], ["AI", "Fintech", None]
    rows = [(i, r.choice(["Acme", "Big Co", "acme-labs", "Zed"]) + str(i % 7), r.choice(sectors), r.choice(cities), r.choice(["Sydney", None]), r.choice([True, False, None]), r.choice([["a"], ["a", "b"], [], None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, name string, sector string, city string, metro string, hiring boolean, tech array<string>").cache()
    t = catalog.Fields(sector="sector", city="city", metro="metro", search=("name", "sector"), member={"tech": "tech"}, flag={"hiring": "hiring"})
    for _ in range(40):
        q = {"search": r.choice(["", "acme", "BIG c", "acmelabs", "fin\ntech"]), "sector": r.choice(["", "AI", "AI,Fintech"]), "city": r.choice(["", "Sydney"]), "tech": r.choice(["", "b"]), "hiring": r.choice(["", "yes", "no", "maybe"])}
        f = catalog.Filters.read(q, t)

        def keep(x):
            s = q["search"].lower().replace("\n", " ")
            squeezed = "".join(c for c in s if c.isalnum())
            hay = "\n".join(v for v in (x[1], x[2]) if v is not None).lower()
            if s and s not in hay and not (len(squeezed) >= 5 and squeezed in "".join(c for c in x[1].lower() if c.isalnum())):
                return False
            if q["sector"] and x[2] not in q["sector"].split(","):
                return False
            if q["city"] and x[3] != q["city"] and x[4] != q["city"]:
                return False
            if q["tech"] and q["tech"] not in (x[6] or []):
                return False
            return not (q["hiring"] in ("yes", "no") and bool(x[5]) != (q["hiring"] == "yes"))

        assert sorted(x.id for x in catalog.select(df, f, t).collect()) == [x[0] for x in rows if keep(x)], q


def test_orders_and_pages(spark):
    df = spark.createDataFrame([(0, "b"), (1, "A"), (2, "a"), (3, "B")], "pos int, name string")
    ordered = catalog.order_by(df, [], "name", "pos")
    assert [r.name for r in ordered.collect()] == ["a", "A", "b", "B"]
    assert [r.name for r in catalog.page(ordered, 1, 2).collect()] == ["A", "b"]
    stages = spark.createDataFrame([("Seed",), ("Odd",), ("Unknown",), (None,), ("Pre-seed",)], "s string")
    assert [r[0] for r in stages.orderBy(catalog.stage_rank(F.col("s")), F.col("s").desc_nulls_last()).collect()] == ["Pre-seed", "Seed", "Odd", "Unknown", None]


def test_facets_of_arrays_and_areas(spark):
    df = spark.createDataFrame([(1, "x", ["p", "q"]), (2, "x", ["p"]), (3, None, None), (4, "", [])], "id int, c string, inv array<string>")
    got = {(r.facet, r.value): (r["count"], r["distinct"]) for r in catalog.facets(df, {"c": "c", "investor": "inv"}).collect()}
    assert got == {("c", "x"): (2, 1), ("investor", "p"): (2, 2), ("investor", "q"): (1, 2)}


def test_summaries_count_members_of_arrays(spark):
    df = spark.createDataFrame([(1, "x", ["p", "q"]), (2, "y", ["p", None]), (3, "x", None), (4, None, [])], "id int, c string, inv array<string>")
    got = catalog.summary(df, {"first": F.col("id") < 2}, {"cs": "c", "investors": "inv"}, {"last": "id"}).first()
    assert (got["count"], got["first"], got.cs, got.investors, got["last"]) == (4, 1, 2, 2, 4)
    none = catalog.summary(df.limit(0), {}, {"investors": "inv"}, {}).first()
    assert (none["count"], none.investors) == (0, 0)


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "hi", ok', None)], "a string, b string, c string")
    line = catalog.csv_lines(df, {c: F.col(c) for c in "abc"}, []).first().line
    assert line == '\'=1+1,"say ""hi"", ok",'
    sinks.write_csv(df, {c: F.col(c) for c in "abc"}, str(tmp_path / "x"))
    assert (next((tmp_path / "x/header").glob("part-*"))).read_bytes() == b"a,b,c\r\n"
    entry = df.select(sinks.calendar_entry(F.lit("1"), F.lit("A, b"), F.lit(NOW), F.lit(None).cast("timestamp"), F.lit("x\ny"), F.lit(None).cast("string")).alias("e")).first().e
    assert "SUMMARY:A\\, b\r\n" in entry and "LOCATION:x\\ny" in entry and "DTSTART:20261005T040000Z" in entry


STORED = "source_id string, external_id string, url string, title string, status string, first_seen_at timestamp, last_confirmed_at timestamp, status_changed_at timestamp, absent_reads int"
READ = "source_id string, external_id string, url string, title string"


def stored_row(ext, url, status="open", changed=NOW - timedelta(hours=2), source="s"):
    return (source, ext, url, "old", status, NOW - timedelta(days=3), NOW - timedelta(days=1), changed, int(status != "open"))


def test_complete_reads(spark):
    stored = spark.createDataFrame(
        [
            stored_row("1", "u1"), stored_row("2", "u2", "hidden"), stored_row("3", "u3"), stored_row("4", "u4", "hidden"), stored_row("5", "u5", "hidden", NOW - timedelta(minutes=10)),
            stored_row(None, "u6"), stored_row("7", "u7", source="other"), stored_row("9", "u9", "closed"),
        ],
        STORED,
    )
    read = spark.createDataFrame([("s", "1", "u1", "new"), ("s", "2", "u2", "new"), ("s", "66", "u6", "new"), ("s", "8", "u8", "new"), ("s", "88", "u8", "twin")], READ)
    out = incremental.apply_read(stored, read, F.lit(NOW)).collect()
    got = {(r.source_id, r.external_id): (r.action, r.status, r.absent_reads, r.title) for r in out}
    assert got == {
        ("s", "1"): ("updated", "open", 0, "new"), ("s", "2"): ("reopened", "open", 0, "new"), ("s", "3"): ("hidden", "hidden", 1, "old"), ("s", "4"): ("archived", "archived", 2, "old"),
        ("s", "5"): ("kept", "hidden", 1, "old"), ("s", "66"): ("adopted", "open", 0, "new"), ("other", "7"): ("kept", "open", 0, "old"), ("s", "8"): ("added", "open", 0, "new"), ("s", "9"): ("kept", "closed", 1, "old"),
    }
    again = incremental.apply_read(spark.createDataFrame(out).drop("action"), read, F.lit(NOW + timedelta(minutes=40)))
    acts = {r.external_id: (r.action, r.status) for r in again.collect()}
    assert acts["3"] == ("archived", "archived") and acts["1"] == ("updated", "open") and acts["66"] == ("updated", "open")


def test_clocks(spark):
    clocks = spark.createDataFrame([("a", None, None, 0, 0, None), ("b", None, None, 2, 0, None), ("c", None, None, 0, 1, NOW - timedelta(minutes=15)), ("d", None, NOW, 1, 0, None)], "source_id string, last_success_at timestamp, next_attempt_at timestamp, consecutive_failures int, empty_reads int, empty_first_at timestamp")
    outcomes = spark.createDataFrame([("a", NOW, True, 0, 5, None, None), ("b", NOW, False, None, 5, True, None), ("c", NOW, True, 0, 5, None, None), ("e", NOW, True, 3, 0, None, None)], "source_id string, at timestamp, ok boolean, rows int, held int, transient boolean, retry_after_seconds int")
    got = {r.source_id: r for r in incremental.note_outcomes(clocks, outcomes).collect()}
    assert not got["a"].accepted and got["a"].empty_reads == 1 and got["a"].empty_first_at == NOW
    assert got["b"].consecutive_failures == 3 and got["b"].next_attempt_at == NOW + timedelta(minutes=180)
    assert got["c"].accepted and got["c"].empty_reads == 0 and got["c"].next_attempt_at == NOW + timedelta(minutes=55)
    assert got["d"].next_attempt_at == NOW and got["d"].consecutive_failures == 1 and got["e"].accepted


def test_queue(spark):
    tasks = spark.createDataFrame([("t1", "x", "queued", 10, ["a"], NOW), ("t2", "y", "done", 10, ["a"], NOW)], "id string, target_id string, status string, priority int, wanted array<string>, created_at timestamp")
    asked = spark.createDataFrame([("x", 50, ["b"], NOW), ("y", 5, ["c"], NOW), ("z", 7, ["c", "c"], NOW)], "target_id string, priority int, wanted array<string>, created_at timestamp")
    got = {(r.target_id, r.status): (r.id, r.priority, r.wanted) for r in incremental.enqueue(tasks, asked).collect()}
    assert got == {("x", "queued"): ("t1", 50, ["a", "b"]), ("y", "done"): ("t2", 10, ["a"]), ("y", "queued"): ("enq-y-2", 5, ["c"]), ("z", "queued"): ("enq-z-1", 7, ["c"])}


def test_reads_as_a_stream(spark, tmp_path):
    schema = READ + ", read_at timestamp"
    table = ReadTable(spark, str(tmp_path / "t"), STORED)
    table.apply(spark.createDataFrame([("s", "1", "u1", "a", NOW), ("s", "2", "u2", "b", NOW)], schema), 0)
    table.apply(spark.createDataFrame([("s", "1", "u1", "a2", NOW + timedelta(hours=1))], schema), 1)
    assert {(r.external_id, r.status, r.title) for r in table.version(1).collect()} == {("1", "open", "a2"), ("2", "hidden", "b")}
    spark.createDataFrame([("s", "3", "u3", "c", NOW)], schema).write.parquet(str(tmp_path / "in"))
    stream = ReadTable(spark, str(tmp_path / "s"), STORED)
    stream.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c")).awaitTermination()
    assert [r.external_id for r in stream.version(0).collect()] == ["3"]


def test_windows_and_sessions_stream(spark, tmp_path):
    spark.createDataFrame([(NOW + timedelta(minutes=m), "k", 1.0) for m in (0, 5, 70, 300)], "ts timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    for df, want in ((windowed(s, "ts", ["k"], "v"), {2, 1}), (sessions(s, "ts", ["k"]), {2, 1})):
        name = f"m{len(df.columns)}"
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert {r.n for r in spark.table(name).collect()} == want


def test_resolution_equals_comparing_all_pairs(spark):
    r = random.Random(7)
    words = ["acme", "bolt", "zephyr", "quantum", "lumen", "lab", "labs", "group", "works", "data"]

    def name():
        n = "".join(r.choice(words) for _ in range(r.randint(1, 3)))
        if r.random() < 0.5:
            i = r.randrange(len(n))
            n = n[:i] + r.choice("xyz") + n[i + r.randint(0, 1) :]
        return n + r.choice(["", " labs", " Pty Ltd", " works"])

    def rows(prefix, n):
        return [(f"{prefix}{i}", name(), r.choice([None, "a.com", "b.io", f"{prefix}{i}.dev"]), r.choice(["sydney", "perth", None])) for i in range(n)]

    schema = "id string, name string, domain string, city string"
    leads, records = (resolution.identities(spark.createDataFrame(rows(p, n), schema), F.col("name"), F.col("domain")).cache() for p, n in (("l", 40), ("r", 60)))
    every = leads.select(F.col("id").alias("lead_id")).crossJoin(records.select(F.col("id").alias("record_id")))
    want = {tuple(x) for x in resolve.compare(every, leads, records).collect()}
    got = {tuple(x) for x in resolve.compare(resolve.pairs(leads, records), leads, records).collect()}
    assert got == want and len(want) > 40
    ranks = resolve.resolve(leads, records).groupBy("lead_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(x.m == x.n <= 5 for x in ranks)


def test_long_names_equal_comparing_all_pairs(spark):
    """Keys of 49 to 200 characters: a letter put into each part but the last, edits anywhere and at the bound, words swapped."""
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names, spelt = [], []
    for size in [49, 53, 54, 57, 64, 65, 66, 72, 80, 99, 128, 150, 200]:
        name = "".join(r.choice(letters) for _ in range(size))
        names.append(name)
        most = int((1 - names_of.SIMILAR) * size / names_of.SIMILAR + 1e-9)
        width = size // (most + 1)
        spelt.append("".join(c + ("9" if i % width == width // 2 and i // width < most else "") for i, c in enumerate(name)))
        spelt.append("".join("9" if i % (size // most + 1) == 1 else c for i, c in enumerate(name)))
        spelt.append("9" + name[1 : size // 2] + "8" + name[size // 2 + 1 :])
        spelt.append(name[size // 2 :] + name[: size // 2])
        cut = set(r.sample(range(size), int(0.16 * size)))
        spelt.append("".join(c for i, c in enumerate(name) if i not in cut))
    schema = "id string, name string, domain string, city string"
    rows = lambda p, ns: [(f"{p}{i}", n, None, None) for i, n in enumerate(ns)]
    leads, records = (resolution.identities(spark.createDataFrame(rows(p, ns), schema), F.col("name"), F.col("domain")).cache() for p, ns in (("l", spelt), ("r", names)))
    every = leads.select(F.col("id").alias("lead_id")).crossJoin(records.select(F.col("id").alias("record_id")))
    want = {tuple(x) for x in resolve.compare(every, leads, records).collect()}
    got = {tuple(x) for x in resolve.compare(resolve.pairs(leads, records), leads, records).collect()}
    assert got == want and len(want) > 45
    assert {x[1] for x in want} == {f"r{i}" for i in range(len(names))}


def test_outcome_rules(spark):
    identity = "id string, names array<struct<key:string,loose:string,kind:string>>, domains array<struct<domain:string,shared:boolean,via:string>>, abn array<string>, acn array<string>, city string, state string, address string, people array<string>"

    def row(i, name="acme", domain=None, shared=False, abn=(), city=None, people=(), kind="primary"):
        return (i, [(name, name, kind)], [(domain, shared, "website")] if domain else [], list(abn), [], city, None, None, list(people))

    cases = [
        (row("l", abn=["1"]), row("r", abn=["1"]), "EXACT_MATCH", 1.0),
        (row("l", "other", abn=["1"]), row("r", abn=["1"]), "LIKELY_MATCH", 0.8),
        (row("l", domain="a.com"), row("r", domain="a.com"), "EXACT_MATCH", 0.99),
        (row("l", domain="a.com", abn=["1"]), row("r", domain="a.com", abn=["2"]), "LIKELY_MATCH", 0.88),
        (row("l", "acmeco", domain="a.com"), row("r", "acmeco", domain="b.com"), "POSSIBLE_MATCH", 0.43),
        (row("l", "abc"), row("r", "abc"), "POSSIBLE_MATCH", 0.43),
        (row("l", "abc", city="perth"), row("r", "abc", city="perth"), "LIKELY_MATCH", 0.75),
        (row("l", "zzz", people=["a b"]), row("r", "yyy", people=["a b"]), "POSSIBLE_MATCH", 0.36),
        (row("l", "acmebank"), row("r", "acme"), "POSSIBLE_MATCH", 0.34),
    ]
    for lead, record, outcome, score in cases:
        found = resolve.resolve(spark.createDataFrame([lead], identity), spark.createDataFrame([record], identity)).collect()
        assert [(x.outcome, x.score) for x in found] == [(outcome, pytest.approx(score, abs=0.011))], (lead, record)


def test_evidence_ids_and_members(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, "b", "x")], "_pos int, c string, f string")
    assert [r.id for r in evidence.evidence_ids(df, ["c", "f"]).orderBy("_pos").collect()] == ["a.x", "a.x.2", "b.x"]
    rows = spark.createDataFrame([("1", ["Python", "Go"]), ("2", ["Go"])], "company_id string, tech array<string>")
    claims = spark.createDataFrame([("1", "python ")], "company_id string, value string")
    got = {r.company_id: r.tech for r in evidence.backed_members(rows, claims, "company_id", "tech").collect()}
    assert got == {"1": ["Python"], "2": None}


def test_states_and_violations(spark):
    df = spark.createDataFrame([("x", 1.0, ["a"]), (" ", float("nan"), []), ("TBD", None, None), (None, float("inf"), None)], "s string, n double, a array<string>")
    got = df.select(quality.state_of(F.col("s")).alias("s"), quality.state_of(F.col("n"), "number").alias("n"), quality.state_of(F.col("a"), "array").alias("a")).collect()
    assert [tuple(r) for r in got] == [("present", "present", "present"), ("empty", "invalid", "empty"), ("unknown", "null", "null"), ("null", "invalid", "null")]


def test_boards(spark):
    answers = spark.createDataFrame(
        [
            ("s1", "greenhouse", '{"jobs":[{"id":1,"title":" Dev ","absolute_url":"https://B.io/1?utm_source=x","location":{"name":"Sydney"},"departments":[{"name":"Eng"}]}],"meta":{"total":1}}'),
            ("s2", "greenhouse", '{"jobs":[],"meta":{"total":2}}'), ("s3", "lever", '[{"id":"a","text":"Ops","hostedUrl":"https://l/a","categories":{"location":"Perth","commitment":"Full-time"},"workplaceType":"remote"}]'), ("s4", "lever", "oops"),
        ],
        "source_id string, provider string, body string",
    )
    got = {(r.source_id, r.external_id, r.title, r.canonical_url, r.location, r.team, r.workplace) for r in boards.postings(answers).collect()}
    assert got == {("s1", "1", "Dev", "https://b.io/1", "Sydney", "Eng", None), ("s3", "a", "Ops", "https://l/a", "Perth", None, "remote")}
    assert {r.source_id for r in boards.incomplete(answers).collect()} == {"s2", "s4"}
    html = spark.createDataFrame([('<a href="https://jobs.lever.co/Acme/x"><a href="https://boards.greenhouse.io/bolt">',)], "h string")
    assert html.select(boards.boards_in(F.col("h")).alias("b")).first().b == ["greenhouse/bolt", "lever/acme"]
    words = spark.createDataFrame([("Senior Engineer", "Full-time"), ("Head of Data", "Contractor"), ("Intern", "internship"), ("Chef", None)], "t string, e string")
    assert [tuple(r) for r in words.select(boards.level(F.col("t")), boards.employment(F.col("e"))).collect()] == [("senior", "full_time"), ("head", "contract"), ("intern", "internship"), ("mid", None)]


def test_tables(spark, tmp_path):
    (tmp_path / "sources.json").write_text('[{"id":"a","kind":"press","url":"https://x"},{"id":"b"}]')
    got = tables.read_all(spark, str(tmp_path))
    assert [r.id for r in got["sources"].orderBy("_pos").collect()] == ["a", "b"] and got["evidence"].count() == 0
    (tmp_path / "p.csv").write_text('Full Name,E-mail,Junk\n"Ann ""A"" Lee",a@b.co,x\n"Bo\nLine",,y\n')
    rows, ignored = tables.rename_by_synonyms(tables.read_csv(spark, str(tmp_path / "p.csv")), {"name": ("full name",), "email": ("e-mail", "mail"), "city": ()})
    assert {tuple(r) for r in rows.collect()} == {('Ann "A" Lee', "a@b.co", None), ("Bo\nLine", None, None)} and ignored == ["Junk"]
    lines = spark.createDataFrame([('{"d":{"rows":[{"n":"x","p":{"c":"y"}},{"n":"z"}]}}',)], "body string")
    assert [tuple(r) for r in tables.records_of(lines, "body", "d.rows", {"name": "n", "city": "p.c"}).collect()] == [("x", "y"), ("z", None)]
