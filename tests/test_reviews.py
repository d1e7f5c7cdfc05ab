from datetime import datetime

from pyspark.sql import functions as F

from tracefold.functions import dates, headlines
from tracefold.operators import reviews


def test_rotation_is_fnv(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h % dates.ROTATION_BLOCKS

    keys = ["", "a", "acme", "acme-labs-2", "x" * 200, "0", "12345"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(dates.rotation_bucket(F.col("k"))).collect()] == [fnv(k) for k in keys]


def test_due_for_discovery(spark):
    now = datetime(2026, 10, 5, 4)
    old, fresh = datetime(2026, 9, 1), datetime(2026, 10, 5, 1)
    ids = [f"c{i}" for i in range(60)]
    mine = {r.k for r in spark.createDataFrame([(i,) for i in ids], "k string").where(dates.rotation_bucket(F.col("k")) == dates.half_day_block(F.lit(now)) % 14).collect()}
    rows = [(i, old, False, False, None) for i in ids] + [("never", None, True, False, None), ("covered", old, True, False, now), ("broken", old, True, True, now), ("hinted", old, False, False, fresh)]
    rows += [(f"{i}x", fresh, False, False, None) for i in ids]
    df = spark.createDataFrame(rows, "id string, checked_at timestamp, covered boolean, failing boolean, hint_at timestamp")
    got = [r.id for r in reviews.due_for_discovery(df, F.lit(now), 100).orderBy("rank").collect()]
    assert got[0] == "never" and set(got) == {"never", "broken", "hinted", *mine} and mine


def test_zoned_times(spark):
    rows = [("2026-10-04T01:30", None, "Australia/Sydney"), ("2026-10-04", "2026-10-05", "Australia/Sydney"), ("2026-07-01T09:00", "2026-07-01T10:00", "Australia/Perth")]
    df = spark.createDataFrame(rows, "s string, e string, z string")
    got = [(r.x["from"], r.x["to"]) for r in df.select(dates.event_span(F.col("s"), F.col("e"), F.col("z")).alias("x")).collect()]
    assert got == [
        (datetime(2026, 10, 3, 15, 30), datetime(2026, 10, 3, 15, 30)),
        (datetime(2026, 10, 3, 14), datetime(2026, 10, 5, 13)),  # clocks go forward in between
        (datetime(2026, 7, 1, 1), datetime(2026, 7, 1, 2)),
    ]
    slots = spark.createDataFrame([(datetime(2026, 7, 1, 22),), (datetime(2026, 7, 2, 3),), (datetime(2026, 10, 5, 9, 30),), (datetime(2026, 7, 1, 9, 30),)], "t timestamp")
    assert [r[0] for r in slots.select(dates.slot(F.col("t"))).collect()] == ["2026-07-02 AM", None, "2026-10-05 PM", None]


def test_headlines(spark):
    rows = [
        ("Sydney-based fintech Zorble raises $100m Series B", "Zorble", "Series B", "Sydney"),
        ("Exclusive: Mild Brew lands A$8.5 million in seed funding", None, "Seed", None),
        ("Meet Mild Brew", None, None, None),
        ("Five startups share $20m", None, None, None),
        ("Why Acme raised $5m", None, None, None),
        ("Aussie robotics startup Acme Works secures $2m pre-seed round", "Acme Works", "Pre-seed", None),
        ("Acme and Bolt raise $5m", None, None, None),
        ("Acme raises its series a+", "Acme", "Series A+", None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(headlines.company(F.col("t")), headlines.funding_round(F.col("t")), headlines.city_hint(F.col("t"))).collect()
    for r, g in zip(rows, got, strict=True):
        if r[0].startswith("Exclusive"):
            assert g[1] == "Seed"
        else:
            assert tuple(g) == r[1:], r[0]
    names = F.array(*map(F.lit, ("Nightjar", "Oak", "OakLine", "Main St. (VC)", "Bird")))
    (found,) = df.limit(1).select(headlines.investors_in(F.lit("led by OakLine, Main St. (VC) and Nightjars; Bird"), names)).first()
    assert found == ["OakLine", "Main St. (VC)", "Bird"]
