"""Shared folder, column guards and match spans, for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session without spark.checkpoint.dir (tests, a single machine) keeps its intermediate tables.
LOCAL_SHARED = "/tmp/tracefold-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may go without."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: there is no folder that the driver and all executors share")
    return (path or LOCAL_SHARED).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tracefold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned, once all that was made of them is written itself."""
    for df in tables:
        found, path = open_fs(df.scratch_path)
        found.delete_dir(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Spans in one step of the running sum below: its cost is matches x STEP, never matches squared.
STEP = 256


def running_starts(gaps: Column, hits: Column) -> Column:
    """Start of each hit, from the texts before, between and after the hits.

    gaps has one element more than hits. Sums run in blocks of STEP, so that a text of very many matches stays linear.
    """
    n = F.size(hits)
    widths = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    blocks = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(STEP))).otherwise(F.array().cast("array<int>")),
        lambda b: F.slice(widths, b + 1, STEP),
    )
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["g"] + x["h"])
    bases = F.aggregate(
        blocks,
        F.array(F.lit(0)),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(b))),
    )
    within = lambda b, base: F.aggregate(
        b,
        F.struct(base.alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + x["g"] + x["h"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["g"])).alias("starts")),
    )["starts"]
    return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), within))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,hit>>: the leftmost non-overlapping matches of `pattern`, starts in code points.

    Only built-in functions: the matches come from regexp_extract_all, the texts between them from split by the same pattern.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = running_starts(F.split(text, pattern, -1), hits)
    return F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), h.alias("hit")))
