"""Submissions by cursor, and a queue as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.plans.base import query
from tracefold.session import table
from tracefold.shared import fresh_path


@query("""
WITH s AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN 'https://c' || c_custkey || '.example' WHEN 1 THEN 'c' || c_custkey || '.example' ELSE 'none' END AS w,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS d, ['seed', 'Series a', 'IPO'][c_custkey % 3 + 1] AS st, ['pending', 'done', 'spam', NULL][c_custkey % 4 + 1] AS status FROM customer)
SELECT id::VARCHAR AS key, name, CASE WHEN w <> 'none' THEN CASE WHEN starts_with(w, 'https') THEN w ELSE 'https://' || w END END AS website, nullif(d, '') AS description,
  CASE st WHEN 'seed' THEN 'Seed' WHEN 'Series a' THEN 'Series A' END AS stage,
  (CASE WHEN w <> 'none' THEN 1 ELSE 0 END + CASE WHEN d <> '' THEN 1 ELSE 0 END + CASE WHEN st <> 'IPO' THEN 1 ELSE 0 END)::INTEGER AS claims
FROM s WHERE trim(name) <> '' AND status = 'pending'
""")
def pending_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Customers as submissions, read by pages of a cursor; of each status only the pending ones are read."""
    from tracefold.sources.submissions import SCHEMA, leads, register

    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    site = F.when(k % 3 == 0, F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example"))).when(k % 3 == 1, F.concat(F.lit("c"), k.cast("string"), F.lit(".example"))).otherwise("none")
    rows = table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 13 == 0, "  ").otherwise(F.col("c_name")).alias("name"), site.alias("website"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("description"),
        pick("seed", "Series a", "IPO").alias("stage"), F.lit("who@mail.example").alias("email"), F.lit(None).cast("string").alias("submitted_at"), pick("pending", "done", "spam", None).alias("status"),
    )
    path = fresh_path(spark, "submissions")
    rows.select([c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(path)
    register(spark)
    read = spark.read.format("submissions").option("path", path).option("page", "500").option("status", "pending").load()
    return leads(read).select("key", "name", "website", "description", "stage", "claims")


@query()
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """The tasks of users after all events, as a stream with state and timers; tests hold it against a fold one by one."""
    from tracefold.streaming.queue import ROCKS, latest, queue_states
    from tracefold.streaming.run import to_table

    t = F.col("event_type")
    kind = F.when(t.isin("view", "signup"), "ask").when(t == "click", "claim").when(t == "purchase", "done").otherwise("fail")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    events = events.select(F.col("user_id").cast("string").alias("task"), kind.alias("kind"), F.col("ts").alias("at"), (F.col("event_id") % 5).cast("int").alias("priority"), F.col("event_id").alias("tie"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return latest(to_table(queue_states(events), "update"))
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
