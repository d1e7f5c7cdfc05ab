from pyspark.sql import functions as F

from tracefold.operators import merges, settle


def test_merges_follow_chains_and_refuse_what_has_no_end(spark):
    records = spark.createDataFrame([(1, "One", ["Uno"]), (2, "Two", None), (3, "Three", ["one"]), (4, "Four", []), (5, "Five", []), (6, "Six", []), (7, "Seven", [])], "id long, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 99), (7, 6), (None, 3), (3, None)], "old long, new long")
    links = spark.createDataFrame([(10, 1, "a"), (11, 3, "A"), (12, 2, "b"), (13, 6, "c"), (14, 1, "d"), (15, None, "e"), (16, 3, "x"), (17, 3, "X")], "link long, record long, what string")
    notes = spark.createDataFrame([(1, 10), (2, 12)], "note long, link long")
    done = merges.merge_records(records, "id", "name", "aliases", asked, {"links": merges.Reference(links, "link", ("record",), ("what",))})
    got = {r.id: sorted(r.aliases or []) for r in done.records.collect()}
    # `One` is among the aliases of 3 already, in another case
    assert got == {3: ["Two", "Uno", "one"], 4: [], 5: [], 6: ["Seven"]}
    assert {(r.old, r.why) for r in done.refused.collect()} == {(4, "cycle"), (5, "cycle"), (6, "unknown")}
    assert {(r.link, r.record, r.moved) for r in done.tables["links"].collect()} == {(11, 3, False), (12, 3, True), (13, 6, False), (14, 3, True), (15, None, False), (16, 3, False), (17, 3, False)}
    assert [r.link for r in done.dropped["links"].collect()] == [10]
    assert {(r.note, r.link) for r in merges.cleared(notes, "link", done.dropped["links"], "link").collect()} == {(1, None), (2, 12)}


def test_nothing_is_merged_into_what_is_closed(spark):
    records = spark.createDataFrame([(1, "a", []), (2, "b", [])], "id long, name string, aliases array<string>")
    done = merges.merge_records(records, "id", "name", "aliases", spark.createDataFrame([(1, 2)], "old long, new long"), {}, spark.createDataFrame([(2,)], "id long"))
    assert done.records.count() == 2 and [(r.old, r.why) for r in done.refused.collect()] == [(1, "closed")]


def test_an_identifier_has_one_owner(spark):
    held = spark.createDataFrame([("a", "domain", "x.com")], "record string, scheme string, value string")
    asked = spark.createDataFrame([("b", "domain", "X.com", 1), ("a", "domain", "x.com", 2), ("c", "abn", "1", 3), ("d", "abn", "1", 4), ("c", "abn", "1", 5), ("c", "alias", "n", 6), ("d", "alias", "n", 7), ("d", "abn", "", 8)], "record string, scheme string, value string, pos long")
    got = {r.pos: (r.outcome, r.owner) for r in merges.claim_identifiers(held, asked, {"domain": "lower(value)"}).collect()}
    assert got == {1: ("held", "a"), 2: ("recorded", "a"), 3: ("added", "c"), 4: ("held", "c"), 5: ("recorded", "c"), 6: ("added", "c"), 7: ("added", "d")}


def test_three_ways(spark):
    cells = lambda rows: spark.createDataFrame(rows, "id long, field string, value string")
    base = cells([(1, "a", "x"), (1, "b", "x"), (1, "c", "x"), (1, "d", "x"), (1, "e", "x")])
    ours = cells([(1, "a", "x"), (1, "b", "y"), (1, "d", "z"), (1, "e", "p"), (2, "n", "new")])
    theirs = cells([(1, "a", "x"), (1, "b", "x"), (1, "c", "x"), (1, "d", "Z"), (1, "e", "q")])
    got = {(r.id, r.field): (r.state, r.value) for r in settle.three_way(base, ours, theirs, ["id", "field"], lambda a, b: F.lower(a) == F.lower(b)).collect()}
    assert got == {(1, "a"): ("same", "x"), (1, "b"): ("ours", "y"), (1, "c"): ("ours", None), (1, "d"): ("both", "z"), (1, "e"): ("conflict", "x"), (2, "n"): ("ours", "new")}


def test_an_undo_may_be_undone(spark):
    log = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4), (6, 99), (7, 8)], "id long, undoes long")
    assert sorted(r.id for r in settle.in_force(log).collect()) == [1, 3, 5, 6, 7]


def test_settling_and_undoing(spark):
    claims = spark.createDataFrame([(1, "f", 1, "Red", "active"), (1, "f", 2, "red ", "active"), (1, "f", 3, "blue", "active"), (1, "f", 4, "green", "rejected"), (2, "f", 5, "one", "active")], "id2 long, field string, claim_id long, value string, status string")
    stored = spark.createDataFrame([(1, "f", "blue"), (2, "f", "ONE")], "id2 long, field string, value string")

    def after(*decisions):
        d = spark.createDataFrame([(*x,) for x in decisions], "id long, id2 long, field string, kind string, winner string, reason string, undoes long")
        return {r.id2: (r.state, r.value, r.turned_down, r.decision, r.why) for r in settle.settle(claims, stored, d, ["id2", "field"]).collect()}

    red = (10, 1, "f", "settle", "RED", "the page says so", None)
    assert after(red)[1] == ("settled", "Red", 1, 10, None)
    assert after(red, (11, 1, "f", "undo", None, None, 10))[1] == ("open", "blue", 0, None, None)
    assert after(red, (11, 1, "f", "undo", None, None, 10), (12, 1, "f", "undo", None, None, 11))[1] == ("settled", "Red", 1, 10, None)
    assert after((10, 1, "f", "settle", None, "keep it", None))[1] == ("settled", "blue", 2, 10, None)
    assert after((10, 1, "f", "settle", "green", "it is", None))[1] == ("open", "blue", 0, None, "not claimed")
    assert after((10, 1, "f", "settle", "red", "no", None))[1] == ("open", "blue", 0, None, "no reason")
    assert after((10, 1, "f", "dismiss", "red", "not theirs", None))[1] == ("agreed", "blue", 2, None, None)
    assert after((10, 2, "f", "settle", "one", "no need", None))[2] == ("agreed", "ONE", 0, None, "not in conflict")
