"""Steps whose cost must follow the rows: what meets, what is carried and what is worked out how often."""

import random
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracefold.functions import headlines, pages
from tracefold.functions.names import SIMILAR
from tracefold.operators import dealing, enrichment, evidence, facts, quality, relations, resolve, spellings, subscriptions, validate
from tracefold.plans.registry import QUERIES
from tracefold.shared import SWEEP, swept


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffle_bytes(spark) -> int:
    """Of shuffle files on disk; what is to go is gone a moment after its job."""
    time.sleep(2)
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_links_are_held_against_each_other_as_asked(spark):
    at = datetime(2024, 5, 1)
    rows = [("a", "https://x.example/1"), ("b", "http://x.example/1")]
    df = spark.createDataFrame([(i, "s", "lever", u, None, "open", at, at, None) for i, u in rows], "id string, source_id string, provider string, apply_url string, duplicate_key string, status string, first_seen_at timestamp, last_confirmed_at timestamp, posted_at timestamp")
    boards = spark.createDataFrame([("s", "ok", at)], "source_id string, status string, last_success_at timestamp")
    shared = lambda **how: [r.id for r in validate.roles(df, boards, datetime(2024, 5, 2), **how).where("code = 'shared_link'").collect()]
    assert shared() == ["a"]
    assert shared(same_link=lambda url: url) == []


def test_filters_are_counted_without_meeting_rows(spark):
    rows = spark.range(200).select("id", F.array(F.concat(F.lit("sector\x01s"), (F.col("id") % 3).cast("string")), F.concat(F.lit("name\x01n"), F.col("id").cast("string"))).alias("tokens"))
    wanted = spark.createDataFrame([(f, "sector", f"s{f % 4}") for f in range(40)] + [(f, "sector", None) for f in range(40, 42)], "filter int, field string, value string")
    got = {tuple(r) for r in subscriptions.counts(rows, wanted).collect()}
    assert got == {tuple(r) for r in subscriptions.matches(rows, wanted).groupBy("filter").agg(F.count(F.lit(1)), F.min("id")).collect()}
    assert len(got) == 30
    _, filters, met = subscriptions._met(rows, wanted)
    assert (filters.count(), met.count()) == (40, 3)  # three sectors meet three of four sets of terms


def test_headlines_work_out_each_step_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(headlines.company(F.col("t")).alias("c"))
    assert len(plan_of(df)) < 20_000  # the pattern of a name alone is 600 characters; repeated steps made hundreds of it


def test_listed_items_carry_no_records(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "", ""), (5, None, "z")], "id int, k1 string, k2 string")
    records = spark.createDataFrame([(10, "a", "y"), (11, "b", "y"), (12, "b", "x"), (12, "b", "x"), (13, "", "z")], "id int, k1 string, k2 string")
    states = resolve.match_states(items, records, "k1", "k2")
    got = {tuple(r) for r in states.collect()}
    assert got == {(1, "found", 1, 1, "a"), (2, "ambiguous", 2, 1, "b"), (3, "ambiguous", 2, 2, "y"), (4, "unmatched", 0, None, None), (5, "found", 1, 2, "z")}
    assert {(r.item_id, tuple(r.record_ids or ())) for r in resolve.match_list(items, records, "k1", "k2").collect()} == {(1, (10,)), (2, (11, 12)), (3, (10, 11)), (4, ()), (5, (13,))}
    assert "collect_" not in plan_of(states)


def test_pairs_of_owners_are_counted_where_their_lists_are(spark):
    links = spark.createDataFrame([(o, i) for i in range(20) for o in range(12) if (o * i) % 5 < 3] + [(None, 1), (1, None), (3, 3), (3, 3)], "owner int, item int")
    got = {(r.owner, r.other, r.shared) for r in relations.related(links, "owner", "item", 11).collect()}
    of = lambda o: {i for i in range(20) if (o * i) % 5 < 3} | ({3} if o == 3 else set())
    assert got == {(a, b, len(of(a) & of(b))) for a in range(12) for b in range(12) if a != b and of(a) & of(b)}
    physical = relations.related(links, "owner", "item")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in physical.split("Generate")[0]  # pairs are made above all joins


def test_addresses_are_read_once(spark):
    df = spark.createDataFrame([("1 High St, Perth WA 6000", "Unit 2, 1 High Street, Perth 6000")], "a string, b string")
    claims = df.select(F.lit("place").alias("type"), F.lit("address").alias("field"), F.col("a").alias("value"), F.col("b").alias("stored_value"), *[F.lit(None).cast(t).alias(n) for n, t in (("amount", "double"), ("currency", "string"), ("stored_amount", "double"), ("stored_currency", "string"))])
    said = claims.select(evidence.says_the_same(evidence.Claims()).alias("same"))
    assert plan_of(said).count("[–—]") == 2  # one reading of each address
    assert said.collect() == [(True,)]


def test_contacts_are_sought_once(spark):
    df = spark.createDataFrame([("a@b.co 0412 345 678 (02) 9999 1234",)], "t string").select(pages.contacts(F.col("t")).alias("c"))
    assert plan_of(df).count("regexp_extract_all") == 1
    assert [(x.kind, x.text) for x in df.collect()[0].c] == [("email", "a@b.co"), ("mobile", "0412 345 678"), ("phone", "(02) 9999 1234")]


def alike(a: str, b: str) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    pairs = [Counter(map(str.__add__, x, x[1:])) for x in (a, b)]
    dice = 2 * sum((pairs[0] & pairs[1]).values()) / (len(a) + len(b) - 2) if min(len(a), len(b)) >= 6 else 0
    return max(1 - row[-1] / max(len(a), len(b)), dice) >= SIMILAR


def test_names_meet_on_nearly_whole_names(spark):
    r = random.Random(3)
    made = lambda: "".join(r.choice(["ka", "lo", "mi", "tur", "ben", "sol", "yt", "omb"]) for _ in range(r.randint(2, 6))) + r.choice(["", "works"])
    records = sorted({made() for _ in range(220)})
    leads = set(r.sample(records, 40))
    for n in r.sample(records, 110):
        i = r.randrange(len(n))
        leads |= {n[:i] + "x" + n[i:], n[:i] + n[i + 1 :], n[i:] + n[:i], n[:i] + "q" + n[i + 1 :]}
    leads, fits = sorted(leads), lambda n: 5 <= len(n) <= spellings.LONGEST
    want = {(a, b) for a in leads for b in records if a != b and fits(a) and fits(b) and alike(a, b)}
    frame = lambda ns: spark.createDataFrame([(n,) for n in ns], "key string")
    assert {tuple(x) for x in spellings.pairs_of_names(frame(leads), frame(records)).collect()} == want
    assert len(want) > 300
    # a tail that all names have does not bring them together
    tailed = ["".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(9)) + "works" for _ in range(60)]
    people = spark.createDataFrame([(f"{i}", [(n, n, "primary")]) for i, n in enumerate(tailed)], "id string, names array<struct<key:string,loose:string,kind:string>>")
    named = people.select("id", F.explode("names").alias("n"))
    assert resolve._similar(named, named).count() == 0


def test_entries_are_packed_and_paired_a_bounded_number_at_a_time(spark, monkeypatch):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abé") for _ in range(r.randint(5, 15))) for _ in range(150)} | {"a" * 9, "a" * 10, "works" * 4, "works" * 4 + "s"})
    names += ["abc".join(p) for p in (("karotelimonade", "xy"), ("kaxyz", "telimonadexy"), ("kazqx", "telimonadexy"), ("kroteliomade", "yx"), ("7karoteli9onade", "x8"))]
    rows = [(((i % 3) << 40) + i * 4 + 1 + i % 3, n) for i, n in enumerate(names)]  # numbers far apart; one side, the other, both
    monkeypatch.setattr(spellings, "PACKED", 3000)
    monkeypatch.setattr(spellings, "CANDIDATES", 500)
    lengths = Counter(map(len, names))
    rounds = spellings._rounds(lengths)
    assert len(rounds) == 2 and sum(n for _, n in rounds) == sum(sum(spellings._kinds(n).values()) * k for n, k in lengths.items())
    monkeypatch.setattr(spellings, "ENTRIES_A_ROUND", rounds[0][1] // 5)
    rounds = spellings._rounds(lengths)
    assert len(rounds) > 4 and sum(n for _, n in rounds) == sum(sum(spellings._kinds(n).values()) * k for n, k in lengths.items())
    often, met = np.ones(spellings.CELLS, dtype=np.uint64), set()
    for kinds, entries in rounds:
        assert entries <= spellings.ENTRIES_A_ROUND or len(kinds) == 1
        packed = list(spellings._entries(kinds, often, 7)(iter([pa.record_batch({"n": [n for n, _ in rows], "key": [k for _, k in rows]})])))
        assert max(sum(map(len, b.column("data").to_pylist())) for b in packed) < 16 * (spellings.PACKED + 400_000)
        for b in spellings._paired(spellings._near(kinds))(iter(packed)):
            met |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
    crossed = lambda a, b: bool((a & 1 and b & 2) or (a & 2 and b & 1))
    assert all(a < b and crossed(a, b) for a, b in met)
    want = {(m, n) for m, a in rows for n, b in rows if m < n and crossed(m, n) and alike(a, b)}
    assert want <= met and len(want) > 20
    # all the same in rounds on Spark
    frame = lambda side: spark.createDataFrame([(k,) for n, k in rows if n & side], "key string")
    got = {tuple(x) for x in spellings.pairs_of_names(frame(1), frame(2)).collect()}
    assert got == {(a, b) for m, a in rows for n, b in rows if a != b and m & 1 and n & 2 and alike(a, b)}


def test_no_table_of_names_goes_by_way_of_the_driver(spark):
    """Joins of leads and records merge: Spark takes a table for small by its bytes on disk, and 32 bytes a row there are hundreds in the driver."""
    people = spark.createDataFrame([(f"{i}", [("acme", "acme", "primary")], [], [], [], "perth", None, None, []) for i in range(3)], "id string, names array<struct<key:string,loose:string,kind:string>>, domains array<struct<domain:string,shared:boolean,via:string>>, abn array<string>, acn array<string>, city string, state string, address string, people array<string>")
    pairs = resolve.pairs(people, people)
    named = people.select("id", F.explode("names").alias("n"))
    keyed = resolve._keyed(named, "lead_id", 4), resolve._keyed(named, "record_id", 4)
    spelt = spark.createDataFrame([("acme", "acme")], "lead_key string, record_key string")
    for df in (resolve._begun(named, named), resolve._borne(spelt, *keyed), resolve.compare(spark.createDataFrame([("0", "1")], "lead_id string, record_id string"), people, people), resolve.resolve(people, people), QUERIES["resolve_leads"](spark, "/root/testdata/sf0.001")):
        joins = [line for line in plan_of(df).splitlines() if "Join " in line]
        assert joins and all("strategy=merge" in line for line in joins)
    # the only others are with the widths of parts and with pairs of characters, of which there are few
    others = [line for line in plan_of(pairs).splitlines() if "Join " in line and "strategy=merge" not in line]
    assert all("width" in line or "gram" in line for line in others)
    assert {tuple(x) for x in pairs.collect()} == {(f"{i}", f"{j}") for i in range(3) for j in range(3)}


def test_what_is_saved_leaves_no_shuffle_files(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k")).repartition(3, "k").groupBy("k").count()
    before = shuffle_bytes(spark)
    saved = swept(df, "swept")
    assert sorted(map(tuple, saved.collect())) == [(k, len(range(k, 1000, 7))) for k in range(7)]
    assert shuffle_bytes(spark) <= before
    assert spark.conf.get(SWEEP) == "false"


def test_only_fields_that_are_asked_for_are_sought(spark):
    html = '<html><head><title>Acme</title><meta name="description" content="Tools"></head><body>Acme Works Pty Ltd, founded in 1999, ABN 51 824 753 556</body></html>'
    pages_ = spark.createDataFrame([(1, html)], "page_id long, html string")
    row = lambda df: {(x.page, x.field, x.value, x.confidence) for x in df.collect()}
    every, some = facts.page_facts(pages_), facts.page_facts(pages_, fields=facts.VERDICT_FIELDS)
    assert {x[1] for x in row(every)} == {"abn", "legal_name", "founded_year", "description", "title"}
    assert row(some) == {x for x in row(every) if x[1] in facts.VERDICT_FIELDS}
    assert facts.FOUNDED in plan_of(facts.text_facts(pages_)) and facts.FOUNDED not in plan_of(facts.text_facts(pages_, fields=facts.VERDICT_FIELDS))
    assert facts.text_facts(pages_, fields=()).count() == facts.site_names(pages_, fields=()).count() == 0


def test_ids_are_dealt_by_their_number(spark, monkeypatch):
    ids = spark.range(1000).select((F.col("id") % 990).alias("id"))
    assert "Repartition" not in plan_of(quality.not_unique("t", ids, ["id"]))  # few: Spark deals
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 50)
    df = quality.not_unique("t", ids, ["id"])
    assert df.rdd.getNumPartitions() == 20
    assert sorted(r.id for r in df.collect()) == sorted(str(i) for i in range(10))


def test_claims_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(400).select(
        F.concat(F.lit("o-"), (F.col("id") % 395).cast("string")).alias("id"), F.when(F.col("id") % 50 > 0, (F.col("id") % 40).cast("string")).alias("company_id"), (F.col("id") % 7).cast("string").alias("source_id"), F.lit("website").alias("field"),
        F.lit("high").alias("confidence"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("note"), F.when(F.col("id") % 3 > 0, "2003-01-01T00:00:00Z").alias("verified_at"), F.lit("x").alias("value"),
    )
    companies = spark.range(30).select(F.col("id").cast("string"), F.array(F.lit("1"), F.lit("2")).alias("source_ids"), F.when(F.col("id") % 2 > 0, "2002-01-01T00:00:00Z").alias("last_verified_at"))
    sources = spark.range(6).select(F.col("id").cast("string"), F.when(F.col("id") != 2, "2002-01-01T00:00:00Z").alias("retrieved_at"))
    run = lambda: validate.claims(rows, companies, sources, ("website",), F.col("value"))
    want = sorted(map(tuple, run().collect()))
    assert {x[2] for x in want} == {"high_without_check", "no_source_id", "no_company_id", "checked_but_never_read", "source_not_listed", "not_unique", "repeated", "older_than_its_claims"}
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 20)
    df = run()
    assert plan_of(df).count("RepartitionByExpression") == 4  # companies, sources and what is said, ids: each over 20 tasks
    assert sorted(map(tuple, df.collect())) == want


def test_places_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(300).select(
        (F.col("id") % 297).alias("id"), F.when(F.col("id") % 60 > 0, F.col("id") % 50).alias("company_id"), F.when(F.col("id") % 4 > 0, "HEADQUARTERS").otherwise("OFFICE").alias("kind"), F.when(F.col("id") % 3 > 0, "EXACT").otherwise("UNKNOWN").alias("precision"),
        F.lit("1 High St").alias("address"), F.lit("Perth").alias("city"), F.when(F.col("id") % 5 > 0, 1.0).alias("lat"), F.lit(1.0).alias("lng"),
    )
    heads = spark.range(45).select(F.col("id").alias("company_id"), F.lit("EXACT").alias("precision"), F.lit("1 High St").alias("address"), F.lit("Perth").alias("city"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"))
    run = lambda: validate.location_rows(rows, heads)
    want = sorted(map(tuple, run().collect()))
    assert {x[2] for x in want} == {"half_a_point", "no_point", "office_without_place", "not_unique", "no_company_id", "differs_from_company", "two_headquarters"}
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 20)
    df = run()
    assert plan_of(df).count("RepartitionByExpression") == 5  # both sides of one rule about companies, one of two others, ids
    assert sorted(map(tuple, df.collect())) == want


def test_query_of_places_deals_orders(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES["location_violations"](spark, data).collect()))
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 50)
    df = QUERIES["location_violations"](spark, data)
    assert plan_of(df).count("Join ") == 2  # rows know the first of their customer without meeting a table of them
    assert sorted(map(tuple, df.collect())) == want


def test_fields_are_filled_in_one_grouping(spark, monkeypatch):
    claims = [
        (1, "a", "x", "X", "high", 2), (1, "a", "x", "x", "low", 1), (1, "b", "x", "X", "low", 1), (1, "b", "y", "Y", "low", 2), (2, "a", "x", "X", "medium", 1), (2, "b", "x", "X", "high", 1), (3, "a", "x", "X", "high", 1),
        (3, "b", "x", "X", "high", 1), (4, "a", None, None, None, None), (4, "b", None, "N", "high", 1), (4, "b", "x", "X", "low", 2), (None, "a", "x", "X", "high", 1), (5, None, "x", "X", "high", 1), (6, "a", "x", "X", "high", 1),
    ]
    active = spark.createDataFrame(claims, "company_id int, field string, key string, value string, confidence string, pos int")
    touched = spark.createDataFrame([(i, f) for i in (1, 2, 3, 4, 7, None) for f in "ab"] * 2 + [(5, None)], "company_id int, field string")
    stored = spark.createDataFrame([(2, "a", "x"), (2, "b", "z"), (3, "a", None), (6, "a", "x"), (7, "a", "x"), (8, "a", "x"), (None, "a", "x")], "company_id int, field string, stored_key string")
    run = lambda: enrichment.fill_fields(active, touched, stored, ("a",), True)
    want = [
        (1, "a", "fill", "x", "high"), (1, "b", "conflict", None, "low"), (2, "a", "confirmed", "X", "medium"), (2, "b", "differs", "X", "high"), (3, "a", "fill", "X", "high"), (3, "b", "suggest", "X", "high"),
        (4, "a", "suggest", None, "low"), (4, "b", "suggest", "N", "high"),
    ]
    assert sorted(map(tuple, run().collect())) == want
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 5)
    df = run()
    assert sorted(map(tuple, df.collect())) == want
    assert "Join" not in plan_of(df) and plan_of(df).count("Aggregate") == plan_of(df).count("RepartitionByExpression") == 1
