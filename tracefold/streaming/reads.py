"""Complete reads and logs as streams: each micro-batch is one call of the batch operators, so both give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracefold.operators.incremental import apply_read
from tracefold.operators.slices import slices


class ReadTable:
    """A table of rows that micro-batches of complete reads update, kept as numbered versions.

    A batch writes the version of its own number from the one before, so a batch that runs twice writes the same rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def version(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.folder}/v={n}").drop("action")

    def apply(self, batch: DataFrame, n: int, as_of: str = "read_at") -> None:
        """Reconcile the table with the reads of a batch; as_of: their column of the moment, the latest of which counts."""
        moment = batch.agg(F.max(as_of)).first()[0] or datetime(1970, 1, 1)
        apply_read(self.version(n - 1), batch, F.lit(moment)).write.mode("overwrite").parquet(f"{self.folder}/v={n}")

    def run(self, reads: DataFrame, checkpoint: str) -> StreamingQuery:
        """All reads that are there, in order, then stop."""
        return reads.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, by: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of event-time windows; what comes later than `late` is left out, and state is dropped then."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events with no gap longer than `gap`."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))


STREAK = "key string, value string, length long, at timestamp"
#: A slice of a log: whether it has one value only, so that an equal run before it goes on, and the run it ends with.
RUN = T.StructType().add("whole", "boolean").add("value", "string").add("length", "long").add("at", "timestamp")


def _count(run: list, value: str | None, at: datetime | None, stored: int | None) -> None:
    """One more event. What is stored comes before the events of its moment; those from before it change no run."""
    whole, last, length, _ = run
    if stored is not None:
        run[:] = [False, value, stored, at]
    elif length and value == last:
        run[2:] = [length + 1, at]
    else:
        run[:] = [whole and not length, value, 1, at]


def closing_runs(log: DataFrame, stored: DataFrame) -> DataFrame:
    """The run of equal values with which each key's log ends: of (key, value, at, tie) after the runs stored so far."""
    rows = log.select("key", "value", "at", "tie", F.lit(None).cast("long").alias("stored"), F.lit(1).alias("kind"))
    before = stored.select("key", "value", "at", F.lit(None).cast(log.schema["tie"].dataType).alias("tie"), F.col("length").alias("stored"), F.lit(0).alias("kind"))
    parts = slices(rows.unionByName(before), "key", ["at", "kind", "tie", "value"], ["value", "at", "stored"], lambda: [True, None, 0, None], _count, RUN)
    run = lambda x, length: F.struct(x["value"].alias("value"), length.alias("length"), x["at"].alias("at"))
    join = lambda a, x: run(x, F.when(x["whole"] & x["value"].eqNullSafe(a["value"]), a["length"]).otherwise(F.lit(0)) + x["length"])
    none = F.lit(None).cast("struct<value:string,length:bigint,at:timestamp>")
    return parts.select("key", F.aggregate("parts", none, lambda a, x: F.when(a.isNull(), run(x, x["length"])).otherwise(join(a, x))).alias("s")).select("key", "s.*")


class StreakTable:
    """The current run of each key, which micro-batches of (key, value, at, tie) update, kept as numbered versions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.latest = spark, folder, -1

    def version(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], STREAK)
        return self.spark.read.schema(STREAK).parquet(f"{self.folder}/v={n}")

    def apply(self, batch: DataFrame, n: int) -> None:
        closing_runs(batch, self.version(n - 1)).write.mode("overwrite").parquet(f"{self.folder}/v={n}")
        self.latest = n

    def run(self, log: DataFrame, checkpoint: str) -> DataFrame:
        """All that is there, batch by batch; the runs after it."""
        fold(log, self.apply, checkpoint).awaitTermination()
        return self.version(self.latest)


def fold(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a step for each micro-batch of what is there."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
