import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.functions import gazetteer
from tracefold.operators import crawl, deltas, quotes, relations, subscriptions
from tracefold.operators.catalog import Fields, Filters, select


def test_saved_filters_equal_a_selection_each(spark):
    r = random.Random(3)
    pick = lambda xs: r.choice(xs)
    rows = [(i, pick(["Acme", "Zed", None]), pick(["AI", "Fintech", None]), pick(["Tech", "Money", None]), pick(["Perth", "Glebe", None]), pick(["Sydney", None]), pick([["a"], ["a", "b", None], [], None]), pick([True, False, None]), pick(["Seed", "Growth"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, name string, sector string, sgroup string, city string, metro string, tags array<string>, hiring boolean, stage string").cache()
    t = Fields(sector="sector", sector_group="sgroup", city="city", metro="metro", member={"tags": "tags"}, flag={"hiring": "hiring"}, equal={"stage": "stage"})
    sets = {}
    for k in range(40):
        q = {"sector": pick(["", "AI", "AI,Money"]), "city": pick(["", "Sydney", "Perth,Nowhere"]), "tags": pick(["", "b", "a,b"]), "hiring": pick(["", "yes", "no"]), "stage": pick(["", "Seed"]), "name": pick([[], ["Acme", "Odd"]])}
        sets[f"f{k}"] = Filters.read(q, t)
    wanted = subscriptions.clauses(spark, sets)
    got = defaultdict(set)
    for x in subscriptions.matches(subscriptions.tokens(df, "id", t), wanted).collect():
        got[x["filter"]].add(x.id)
    full = {x["filter"] for x in wanted.collect()}
    for k, f in sets.items():
        if k in full:
            assert got[k] == {x.id for x in select(df, f, t).collect()}, (k, f)
    with pytest.raises(ValueError):
        subscriptions.clauses(spark, {"s": Filters(search="x")})


def test_crawl_plans_equal_a_greedy_walk(spark):
    r = random.Random(4)
    fields = [f for _, _, fs in crawl.KINDS for f in fs]
    pages = [(f"s{r.randrange(12)}", i, i, r.sample(sorted(set(fields)), r.randint(0, 4))) for i in range(150)]
    wanted = [(f"s{i}", r.sample(sorted(set(fields)), r.randint(0, 7))) for i in range(13)]
    df, wf = spark.createDataFrame(pages, "site string, page long, pos long, serves array<string>"), spark.createDataFrame(wanted, "site string, fields array<string>")
    for limit in (1, 4):
        want = set()
        for site, left in wanted:
            left = set(left)
            for turn in range(1, limit + 1):
                best = min(((-len(left & set(s)), pos, page, s) for st, page, pos, s in pages if st == site and left & set(s)), default=None)
                if best is None:
                    break
                want.add((site, best[2], turn, tuple(sorted(left & set(best[3])))))
                left -= set(best[3])
        assert {(x.site, x.page, x.turn, tuple(x.covers)) for x in crawl.plan(df, wf, limit).collect()} == want
    kinds = spark.createDataFrame([("/privacy-policy", ""), ("/x", "Our team"), ("/about.PDF", "about"), ("/news", "Careers here"), ("/a", None), (None, None)], "p string, w string")
    assert [x[0] for x in kinds.select(crawl.kind_of(F.col("p"), F.col("w"))).collect()] == ["privacy", "about", None, "careers", None, None]


def test_places(spark):
    said = {
        "Sydney": ("Sydney", "NSW", "Australia", None, "au"), "Melbourne, VIC": ("Melbourne", "VIC", "Australia", None, "au"), "Sydney NSW": ("Sydney", "NSW", "Australia", None, "au"),
        "Perth, Western Australia": ("Perth", "WA", "Australia", None, "au"), "Australia": (None, None, "Australia", None, "au"), "Adelaide, SA": ("Adelaide", "SA", "Australia", None, "au"),
        "SF": ("San Francisco", None, "United States", None, "global"), "Europe": (None, None, None, "Europe", "global"), "Melbourne, Florida": (None, None, None, None, "global"),
        "WA": (None, None, None, None, "global"), "SA": (None, None, None, None, "global"), "Other": (None, None, None, None, "global"), "Richmond": (None, None, None, None, "global"),
        "Sýdney": ("Sydney", "NSW", "Australia", None, "au"), "Sunshine Coast / Brisbane": ("Sunshine Coast", "QLD", "Australia", None, "au"), "we are in new zealand": (None, None, None, None, "global"),
        "Remote | New Zealand": (None, None, "New Zealand", None, "global"), " ": (None, None, None, None, "global"), None: (None, None, None, None, "global"),
    }
    df = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    got = {x.id: (x.city, x.state, x.country, x.region, x.scope) for x in gazetteer.places_named(df, "id", "t", gazetteer.gazetteer(spark)).collect()}
    assert got == dict(enumerate(said.values()))


ARGS = (["k"], "source", "id", "posted", "seen")
ROLE = "id long, k string, source string, posted timestamp, seen timestamp"


def test_groups_after_each_of_five_batches(spark):
    r = random.Random(5)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=r.randrange(50))
    role = lambda i: (i, r.choice(["x", "y", "z", None]), r.choice(["s1", "s2"]), r.choice([None, at()]), at())
    rows = {i: role(i) for i in range(40)}
    state = deltas.first_ranking(spark.createDataFrame(list(rows.values()), ROLE), *ARGS)
    for _ in range(5):
        state = spark.createDataFrame(state.collect(), state.schema)
        before = {x.id: x.duplicate_of for x in state.collect()}
        batch = {i: (*(role(i) if r.random() < 0.6 or i not in rows else rows[i]), r.choice(["put", "put", "remove"])) for i in r.sample(range(50), 8)}
        for i, x in batch.items():
            if x[-1] == "put":
                rows[i] = x[:-1]
            else:
                rows.pop(i, None)
        state, moved = deltas.role_delta(state, spark.createDataFrame(list(batch.values()), f"{ROLE}, op string"), *ARGS)
        want = {x.id: x.duplicate_of for x in deltas.first_ranking(spark.createDataFrame(list(rows.values()), ROLE), *ARGS).collect()}
        got = {x.id: x.duplicate_of for x in state.collect()}
        assert got == want
        assert {(x.id, x.was, x.now) for x in moved.collect()} == {(i, before[i], got[i]) for i in before if i in got and before[i] != got[i]}


def test_a_batch_brings_groups_together_once(spark):
    at = datetime(2024, 1, 1)
    state = deltas.first_ranking(spark.createDataFrame([(1, "x", "s1", at, at), (2, "x", "s2", None, at), (3, None, "s1", at, at)], ROLE), *ARGS)
    state = spark.createDataFrame(state.collect(), state.schema)
    after, _ = deltas.role_delta(state, spark.createDataFrame([(1, "y", "s1", at, at, "put"), (4, "x", "s1", None, at, "put")], f"{ROLE}, op string"), *ARGS)
    assert {x.id: x.duplicate_of for x in after.collect()} == {1: None, 2: None, 3: None, 4: 2}
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Join"), plan.count("Window"), plan.count("Aggregate")) == (2, 1, 0)  # by id, for groups and for rows of none


def test_a_run_that_comes_twice_changes_nothing(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    ledger = spark.createDataFrame([], "key string, entries long, total double, last_value string, last_at struct<at:timestamp,run_id:string,row_no:long>")
    applied = spark.createDataFrame([], "run_id string, row_no long")
    entry = "run_id string, row_no long, key string, amount double, value string, at timestamp"
    first = spark.createDataFrame([("r2", 1, "a", 2.0, "late", t(5)), ("r2", 2, "b", 1.0, "x", t(1)), ("r2", 2, "b", 1.0, "x", t(1))], entry)
    second = spark.createDataFrame([("r1", 1, "a", 3.0, "early", t(2))], entry)
    ledger, applied, out = deltas.apply_ledger(ledger, applied, first)
    assert {(x.run_id, x.taken, x.repeated) for x in out.collect()} == {("r2", 2, 1)}
    ledger, applied, _ = deltas.apply_ledger(ledger, applied, second)
    once = {(x.key, x.entries, x.total, x.last_value) for x in ledger.collect()}
    assert once == {("a", 2, 5.0, "late"), ("b", 1, 1.0, "x")}
    again, applied, out = deltas.apply_ledger(ledger, applied, first.unionByName(second))
    assert {(x.key, x.entries, x.total, x.last_value) for x in again.collect()} == once and {x.taken for x in out.collect()} == {0}


def test_quotes_in_many_blocks(spark):
    """1,500 short quotes and long ones that begin alike, some hundred to a block."""
    docs = [(i, f"Said the  {i} and one {i * i} of many words here, as it was {'long ' * 30}") for i in range(60)] + [(900, None), (None, "said the 1 and")]
    items = [(i, f"{i} and ONE" if i % 2 else f"one {i * i} of") for i in range(1500)]
    items += [(2000, "the 7 and one 49 of many words here"), (2001, f"it was {'long ' * 29}long"), (2002, f"it was {'long ' * 29}short"), (2003, " "), (2004, None), (None, "many words")]
    df, qf = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "quote long, text string")
    flat = lambda x: " ".join((x or "").lower().split())
    want = {(i, d) for i, q in items for d, x in docs if i is not None and d is not None and flat(q) and flat(q) in flat(x)}
    for block in (400, 20_000):
        assert {(x.quote, x.doc) for x in quotes.say(df, qf, block).collect()} == want
    assert quotes.say(df.limit(0), qf).count() == 0 and quotes.say(df, qf.limit(0)).count() == 0


def test_more_people_ask_than_go_at_once(spark, monkeypatch):
    r = random.Random(6)
    some = lambda xs: r.sample(xs, r.randint(0, 2))
    rows = [(i, some(list(relations.FITS)), some(["sql", "ml", "ux"]), some(["art", "food"]), r.choice(["Perth", None]), r.random() < 0.5, some(["chat", "call"]), datetime(2024, 1, 1 + i % 28)) for i in range(120)]
    people = spark.createDataFrame(rows, "id long, looking_for array<string>, skills array<string>, interests array<string>, city string, remote boolean, open_to array<string>, created_at timestamp").cache()
    met = spark.createDataFrame([(1, 2)], "me_id long, other_id long")
    whole = sorted(map(tuple, relations.recommend(people, people, met).collect()))
    monkeypatch.setattr(relations, "ASKING", 50)
    assert sorted(map(tuple, relations.recommend(people, people, met).collect())) == whole and len({x[0] for x in whole}) > 50
