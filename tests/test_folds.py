from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators import folds, slices
from tracefold.plans.registry import QUERIES
from tracefold.streaming.reads import STREAK, closing_runs

DATA = "/root/testdata/sf0.001"


def test_decisions_against_a_plain_loop(spark):
    names = {"signup": "approve", "error": "reject", "view": "reopen", "purchase": "publish", "click": "merge"}
    want = {}
    for e in sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda e: (e.ts, e.event_id)):
        status, ok, bad = want.get(e.user_id * 100 + e.event_id % 100, ("pending", 0, 0))
        to = folds.CANDIDATE_MOVES.get((status, names[e.event_type]))
        want[e.user_id * 100 + e.event_id % 100] = (to or status, ok + bool(to), bad + (not to))
    assert {r.id: (r.status, r.applied, r.refused) for r in QUERIES["candidate_decisions"](spark, DATA).collect()} == want


def test_hidden_posts_and_restoring(spark):
    t = datetime(2026, 1, 1)
    acts = [(1, 9, "create", "a"), (1, 1, "report", None), (1, 1, "report", None), (1, 2, "report", None), (2, 9, "create", "b"), *[(2, i, "report", None) for i in range(3)], (3, 9, "create", "c"), *[(3, i, "report", None) for i in range(3)], (3, 0, "restore", None), (3, 7, "report", None)]
    df = spark.createDataFrame([(*a, t + timedelta(minutes=n), n) for n, a in enumerate(acts)], "post_id int, actor int, action string, text string, at timestamp, seq int")
    got = {r.post_id: (r.status, r.reporters) for r in folds.posts(df).collect()}
    assert got == {1: ("visible", 2), 2: ("hidden", 3), 3: ("visible", 1)}
    rows = spark.createDataFrame([(1, "visible", 5), (2, "hidden", 5), (3, "hidden", 6), (4, "deleted", 5)], "id int, status string, author int")
    assert {r.id for r in folds.visible_to(rows, F.lit(5)).collect()} == {1, 2}


def test_saved_lists_merge(spark):
    t = datetime(2026, 1, 1)
    a = spark.createDataFrame([("o", "x", t), ("o", "y", t + timedelta(1))], "owner string, key string, at timestamp")
    b = spark.createDataFrame([("o", "x", t + timedelta(2)), ("o", "z", t + timedelta(3))], "owner string, key string, at timestamp")
    assert {(r.key, r.at.day) for r in folds.saved(a, b).collect()} == {("x", 1), ("y", 2), ("z", 4)}
    assert {r.key for r in folds.saved(a, b, most=2).collect()} == {"y", "z"}


@pytest.fixture
def uncoalesced(spark):
    """So few rows would else be put together into one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_is_folded_in_many_tasks(uncoalesced):
    """A hot id and key over several tasks, with long closing runs, nulls, a stored run and events from before it."""
    t = datetime(2026, 1, 1)
    actions = ["approve", "reject", "reopen", "publish", None]
    rows = [(1 if i % 3 else 2 + i, actions[i * i % 5 if i < 4000 else 1], t + timedelta(seconds=i // 2), i) for i in range(9000)]
    spark = uncoalesced
    log = spark.createDataFrame(rows, "id long, action string, at timestamp, seq long").repartition(4)
    want, runs = {}, {1: ("reject", 7, t + timedelta(seconds=2500)), 3: ("x", 4, t)}
    stored = [(str(k), *v) for k, v in runs.items()]
    for i, action, at, _ in sorted(rows, key=lambda x: x[2:]):
        status, ok, bad = want.get(i, ("pending", 0, 0))
        to = folds.CANDIDATE_MOVES.get((status, action))
        want[i] = (to or status, ok + bool(to), bad + (not to))
        last, n, since = runs.get(i, (None, 0, None))
        if since is None or at >= since:
            runs[i] = (action, n + 1 if n and action == last else 1, at)
    decided = folds.decide(log, "pending", folds.CANDIDATE_MOVES)
    assert {r.id: (r.status, r.applied, r.refused) for r in decided.collect()} == want
    events = log.select(F.col("id").cast("string").alias("key"), F.col("action").alias("value"), "at", F.col("seq").alias("tie"))
    got = closing_runs(events, spark.createDataFrame([(k, v, n, at) for k, v, n, at in stored], STREAK))
    assert {r.key: (r.value, r.length, r.at) for r in got.collect()} == {str(k): v for k, v in runs.items()}
    parts = slices.slices(events, "key", ["at", "tie"], [], lambda: [0], lambda n: n.__setitem__(0, n[0] + 1), T.StructType().add("n", "long"))
    tasks = {r.key: [p.n for p in r.parts] for r in parts.collect()}
    assert sum(tasks["1"]) == 6000 and len(tasks["1"]) >= 2 and max(tasks["1"]) < 6000
