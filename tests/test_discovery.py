import random

from pyspark.sql import functions as F

from tests.test_scale import plan_of, shuffle_bytes
from tracefold.operators import discovery, graph, resolve

IDENTITY = "names array<struct<key:string,loose:string,kind:string>>, domains array<struct<domain:string,shared:boolean,via:string>>, abn array<string>, acn array<string>, city string, state string, address string, people array<string>"


def identity(r, name=None):
    name = name or r.choice(["acme", "acmeworks", "zebra", "zebrax", "quokka", "quokkalabs", "emu"])
    loose = name.removesuffix("labs") or name
    domains = [(d, False, "website") for d in r.sample(["a.example", "b.example", "c.example"], r.choice([0, 1, 1]))]
    return ([(name, loose, "primary")], domains, [r.choice(["1", "2"])] if r.random() < 0.15 else [], [], r.choice(["perth", "hobart", None]), None, None, [])


def run_one_by_one(leads, companies, candidates, seen, outcome):
    """The run as it reads: each lead against all that is there, in order."""
    done, out, keys = [], {}, set(seen)
    for lead in sorted(leads, key=lambda x: x[1]):
        i, pos, source, key, name = lead[:5]
        plain = " ".join((name or "").split())
        if not 2 <= len(plain) <= 80 or not lead[5] or not lead[5][0][0]:
            out[i] = ("skipped", None)
            continue
        if (source, key) in keys:
            out[i] = ("seen", None)
            continue
        keys.add((source, key))
        found = [(o, "company", s, -1, c) for c in companies if (o_s := outcome(i, ("company", c))) for o, s in [o_s]]
        if sum(x[0] == 3 for x in found) > 1:
            found = [(min(o, 2), *x) for o, *x in found]
        found += [(o, "candidate", s, -1, c) for c in candidates if (o_s := outcome(i, ("candidate", c))) for o, s in [o_s]]
        found += [(o, "candidate", s, p, c) for c, p in done if (o_s := outcome(i, ("lead", c))) for o, s in [o_s]]
        best = min(found, key=lambda x: (-x[0], x[1] == "candidate", -x[2], x[3])) if found else None
        if best and best[0] == 3 and best[1] == "candidate":
            out[i] = ("attached", best[4])
            continue
        done.append((i, pos))
        out[i] = ("matched", best[4]) if best and best[0] == 3 else ("review", best[4]) if best else ("new", None)
    return out


def test_a_run_equals_one_lead_after_another(spark):
    r = random.Random(7)
    leads = []
    for i in range(120):
        who = identity(r)
        if i % 17 == 3:
            who = ([], *who[1:])
        leads.append((f"l{i}", r.randrange(10**6) * 1000 + i, r.choice(["s1", "s2"]), f"k{r.randrange(100)}", who[0][0][0] if who[0] else " ", *who))
    leads.append(("alone", 10**12, "s1", "alone", "platypus", *identity(r, "platypus")[:1], [], [], [], None, None, None, []))
    companies = [(f"c{i}", *identity(r)) for i in range(4)]
    candidates = [(f"d{i}", *identity(r)) for i in range(3)]
    seen = [("s1", "k3"), ("s2", "k9")]
    lead_df = spark.createDataFrame(leads, f"id string, pos long, source_id string, key string, name string, {IDENTITY}")
    company_df, candidate_df = (spark.createDataFrame(x, f"id string, {IDENTITY}") for x in (companies, candidates))
    # what each pair is, worked out for all pairs
    every = [(f"lead:{x[0]}", *x[5:]) for x in leads] + [(f"company:{x[0]}", *x[1:]) for x in companies] + [(f"candidate:{x[0]}", *x[1:]) for x in candidates]
    all_df = spark.createDataFrame(every, f"id string, {IDENTITY}").cache()
    asked = all_df.where("id LIKE 'lead:%'")
    pairs = asked.selectExpr("id AS lead_id").crossJoin(all_df.selectExpr("id AS record_id"))
    what = {(x.lead_id, x.record_id): (resolve.RANK[x.outcome], x.score) for x in resolve.compare(pairs, asked, all_df).collect()}
    want = run_one_by_one(leads, [x[0] for x in companies], [x[0] for x in candidates], seen, lambda i, t: what.get((f"lead:{i}", f"{t[0]}:{t[1]}")))
    got = {x.lead_id: x for x in discovery.run(lead_df, company_df, candidate_df, spark.createDataFrame(seen, "source_id string, key string")).collect()}
    assert {k: v.state for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert len({v.state for v in got.values()}) == 6
    # targets, but for ties between stored records, which go by id
    assert {k: v.target_id for k, v in got.items() if v.state == "attached"} == {k: v[1] for k, v in want.items() if v[0] == "attached"}


def test_a_run_leaves_what_it_says_and_little_else_on_disk(spark):
    r = random.Random(11)
    leads = [(f"l{i}", 10**9 + i * 7, "s", f"k{i}", "x", *identity(r, "".join(r.choice("abcdefgh") for _ in range(14)))) for i in range(200)]
    lead_df = spark.createDataFrame(leads, f"id string, pos long, source_id string, key string, name string, {IDENTITY}").withColumn("name", F.lit("a name"))
    before = shuffle_bytes(spark)
    found = discovery.run(lead_df, spark.createDataFrame([("c", *identity(r))], f"id string, {IDENTITY}"))
    assert shuffle_bytes(spark) - before < 100_000  # counts that are collected; the keys of names alone are more
    joins = [line for line in plan_of(found).splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)
    assert found.count() == 200


def test_nothing_to_discover(spark):
    leads = spark.createDataFrame([], f"id string, pos long, source_id string, key string, name string, {IDENTITY}")
    companies = spark.createDataFrame([], f"id string, {IDENTITY}")
    assert discovery.run(leads, companies).count() == 0


def test_greedy_choices_in_order(spark):
    r = random.Random(2)
    edges = {(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(160)) if a > b} | {(i, i - 1) for i in range(81, 120)}
    ruled = set()
    for late in sorted({e[0] for e in edges} | {e[1] for e in edges}):
        if any(early not in ruled for x, early in edges if x == late):
            ruled.add(late)
    got = {x.id for x in graph.greedy_first(spark.createDataFrame(sorted(edges), "late long, early long")).collect()}
    assert got == ruled
    assert graph.greedy_first(spark.createDataFrame([], "late long, early long")).count() == 0


def test_redirects_and_circles(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 200), (300, 301)]
    ends, endless = graph.closed_redirects(spark.createDataFrame(rows, "old long, new long"))
    assert {(x.old, x.new) for x in ends.collect()} == {(i, 40) for i in range(40)} | {(300, 301)}
    assert {x.old for x in endless.collect()} == {100, 101, 102, 103, 200}
    assert {x.node for x in graph.circles(spark.createDataFrame(rows, "old long, new long")).collect()} == {100, 101, 102, 200}
    assert {x.node for x in graph.on_cycles(spark.createDataFrame(rows, "from long, to long")).collect()} == {100, 101, 102, 200}
    assert graph.closed_redirects(spark.createDataFrame([], "old long, new long"))[0].count() == 0
