import random
from datetime import UTC, datetime, timedelta


from tracefold.plans import intake
from tracefold.sources import submissions
from tracefold.streaming import queue
from tracefold.streaming.run import to_table

EVENT = "task string, kind string, at timestamp, priority int, tie long"


def ms(at):
    return at and int(at.replace(tzinfo=UTC).timestamp() * 1000)


def folded(events, as_of):
    tasks = {}
    for task, kind, at, priority, _ in sorted(events, key=lambda e: (e[2], e[4])):
        tasks[task] = queue.step(tasks.get(task, dict(queue.NEW)), kind, ms(at), priority)
    out = {k: queue.expired(v, ms(as_of)) for k, v in tasks.items()}
    return {k: tuple(v[f] for f in queue.FIELDS if f != "changes") for k, v in out.items() if v["changes"]}


def told(rows):
    return {r.task: tuple(ms(r[f]) if f in queue.MOMENTS else r[f] for f in queue.FIELDS if f != "changes") for r in rows}


def streamed(spark, folder, late="1 hour"):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.ROCKS)
    try:
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        rows = queue.latest(to_table(queue.queue_states(events, late), "update")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return told(rows)


def test_steps_of_a_task():
    t = lambda m: 60_000 * m
    task = queue.step(dict(queue.NEW), "ask", t(0), 2)
    assert (task["status"], task["priority"]) == ("queued", 2)
    assert queue.step(task, "done", t(1), None) == task
    running = queue.step(task, "claim", t(5), None)
    assert (running["status"], running["lease_until"]) == ("running", t(20))
    lost = queue.step(running, "done", t(30), None)
    assert (lost["status"], lost["attempts"], lost["not_before"]) == ("queued", 1, t(30)) and queue.step(lost, "claim", t(29), None) == lost
    third = queue.step(queue.step(lost | {"attempts": 2, "not_before": None}, "claim", t(40), None), "fail", t(41), None)
    assert (third["status"], third["attempts"]) == ("failed", 3)
    assert queue.step(third, "ask", t(50), 1)["attempts"] == 0


def test_a_stream_of_five_batches_equals_a_fold(spark, tmp_path):
    r = random.Random(8)
    start, events = datetime(2024, 1, 1), []
    for i in range(300):
        events.append((f"t{r.randrange(12)}", r.choice(["ask", "ask", "claim", "claim", "done", "fail"]), start + timedelta(minutes=4 * i, seconds=r.randrange(60)), r.randrange(4), i))
    for b in range(5):
        spark.createDataFrame(events[60 * b : 60 * (b + 1)], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    got = streamed(spark, f"{tmp_path}/in/*")
    # leases run out as far as the watermark has come
    assert got == folded(events, max(e[2] for e in events) - timedelta(hours=1))
    assert {v[0] for v in got.values()} >= {"queued", "failed"}


def test_the_query_equals_a_fold(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/events.parquet").collect()
    kind = {"view": "ask", "signup": "ask", "click": "claim", "purchase": "done"}
    at = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
    events = [(str(r.user_id), kind.get(r.event_type, "fail"), at(r.ts), r.event_id % 5, r.event_id) for r in rows]
    got = told(intake.stream_queue(spark, d).collect())
    assert got == folded(events, max(e[2] for e in events) - timedelta(hours=1))


def test_submissions_by_pages_and_as_a_stream(spark, tmp_path):
    rows = [(i, f"n{i}", None, "d", "seed", "who@x", None, ["pending", "done", None][i % 3]) for i in range(5, 505)]
    spark.createDataFrame(rows, submissions.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/s")
    submissions.register(spark)
    read = spark.read.format("submissions").option("path", f"{tmp_path}/s").option("page", "70").load()
    assert sorted(map(tuple, read.collect()), key=lambda x: x[0]) == rows and read.rdd.getNumPartitions() == 8
    want = sorted(x[0] for x in rows if x[-1] == "pending")
    assert sorted(x.id for x in read.where("status = 'pending'").collect()) == want and read.count() == 500
    stream = spark.readStream.format("submissions").option("path", f"{tmp_path}/s").option("page", "70").option("status", "pending").load()
    assert sorted(x.id for x in to_table(stream, "append").collect()) == want
    leads = submissions.leads(read)
    assert "email" not in leads.columns and leads.count() == sum(x[-1] in ("pending", None) for x in rows)
    spark.createDataFrame([], submissions.SCHEMA).write.parquet(f"{tmp_path}/none")
    assert spark.read.format("submissions").option("path", f"{tmp_path}/none").load().count() == 0


def test_leads_of_submissions(spark):
    rows = [(1, "  Acme \n Co ", "ACME.example/x", " d " * 300, "series A", "e", None, None), (2, " ", None, None, None, None, None, "pending"), (3, "Zed", "not a site", "", "IPO", None, "2024", "pending"), (4, "No", None, None, None, None, None, "spam")]
    got = {r.key: r for r in submissions.leads(spark.createDataFrame(rows, submissions.SCHEMA)).collect()}
    assert set(got) == {"1", "3"}
    assert (got["1"].name, got["1"].website, got["1"].stage, len(got["1"].description), got["1"].claims) == ("Acme Co", "https://acme.example/x", "Series A", 500, 3)
    assert (got["3"].website, got["3"].description, got["3"].stage, got["3"].claims, got["3"].observed_at) == (None, None, None, 0, "2024")
