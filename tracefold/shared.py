"""The folder that the driver and all executors share, and tables written there to end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine without spark.checkpoint.dir (tests, benchmarks) keeps what it writes.
LOCAL = "/tmp/tracefold-shared"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: there is no folder that the driver and all executors share")
    return (path or LOCAL).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tracefold/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: rounds of an iteration have short plans, and survive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's switch for removing the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def swept(df: DataFrame, name: str) -> DataFrame:
    """`saved`, after which the shuffle files of `df` are gone: a job of many steps holds on disk what one step shuffles."""
    conf = df.sparkSession.conf
    before = conf.get(SWEEP, None)
    conf.set(SWEEP, "true")
    try:
        return saved(df, name)
    finally:
        conf.unset(SWEEP) if before is None else conf.set(SWEEP, before)
