"""Submissions as a source: read by ranges of a cursor, in batches or as a stream, pending ones only if asked for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import RecordBatch, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id long, name string, website string, description string, stage string, email string, submitted_at string, status string"
COLUMNS = ("id", "name", "website", "description", "stage", "email", "submitted_at", "status")
# Stages that a submission may name.
STAGES = ("Pre-seed", "Seed", "Series A", "Series B", "Series C", "Series D", "Growth", "Early")


@dataclass
class Page(InputPartition):
    """Rows whose cursor lies above `after` and not above `upto`."""

    after: int
    upto: int


def _opened(path: str) -> ds.Dataset:
    found, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return ds.dataset(inner, filesystem=found, format="parquet", ignore_prefixes=["_", "."])


def _ends(path: str) -> tuple[int, int]:
    """The least and the greatest cursor, from the statistics of the files; (0, -1) for no rows."""
    low, high = [], []
    for fragment in _opened(path).get_fragments():
        meta = fragment.metadata if isinstance(fragment, ds.ParquetFileFragment) else pq.read_metadata(fragment.path)
        at = meta.schema.names.index("id")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            if s is not None and s.has_min_max:
                low.append(s.min)
                high.append(s.max)
    return (min(low), max(high)) if low else (0, -1)


def _rows(path: str, page: Page, status: str | None) -> Iterator[RecordBatch]:
    keep = (pc.field("id") > page.after) & (pc.field("id") <= page.upto)
    if status is not None:
        keep = keep & (pc.field("status") == status)
    yield from (b for b in _opened(path).to_batches(columns=list(COLUMNS), filter=keep, use_threads=False) if b.num_rows)


def _pages(after: int, upto: int, size: int) -> list[Page]:
    return [Page(a, min(a + size, upto)) for a in range(after, upto, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.status = options["path"], int(options.get("page", "100000")), options.get("status")

    def partitions(self) -> list[InputPartition]:
        low, high = _ends(self.path)
        return _pages(low - 1, high, self.size) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[RecordBatch]:
        yield from _rows(self.path, partition, self.status)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size, self.status = options["path"], int(options.get("page", "100000")), options.get("status")

    def initialOffset(self) -> dict:
        return {"id": -(2**62)}

    def latestOffset(self) -> dict:
        return {"id": max(_ends(self.path)[1], -(2**62))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low = max(start["id"], _ends(self.path)[0] - 1)
        return _pages(low, end["id"], self.size) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[RecordBatch]:
        yield from _rows(self.path, partition, self.status)

    def commit(self, end: dict) -> None:
        pass


class Submissions(DataSource):
    """spark.read.format("submissions") and spark.readStream: options path (a folder of Parquet), page (cursor values of a partition), status.

    The status is an option, which the files are filtered by, and not a pushed filter: a frame that is read twice, once with a
    pushed filter and once without, got the filtered rows both times.

    A partition is a range of the cursor, an offset the greatest cursor that was read: a page that is read again gives the
    same rows, so a lost executor or a restarted stream loses and repeats nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "submissions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(Submissions)


def leads(rows: DataFrame) -> DataFrame:
    """(key, name, website, description, stage, title, observed_at, claims): pending submissions as leads; the address of who submitted never goes along.

    A submission without a name is none. What it says is a claim of low confidence each: claims counts them.
    """
    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " "))
    text = F.substring(F.trim("description"), 1, 500)
    site = F.lower(F.trim("website"))
    site = F.when(site.rlike(r"^https?://[^/\s]+\.[^/\s]+"), site).when(site.rlike(r"^[^/\s:]+\.[^/\s:]+"), F.concat(F.lit("https://"), site))
    known: Column = F.get(F.filter(F.array(*map(F.lit, STAGES)), lambda s: F.lower(s) == F.lower(F.trim("stage"))), F.lit(0))
    out = rows.where(F.coalesce("status", F.lit("")).isin("", "pending")).select(
        F.col("id").cast("string").alias("key"), name.alias("name"), site.alias("website"), F.when(text != "", text).alias("description"), known.alias("stage"),
        F.concat(F.lit("Submission: "), name).alias("title"), F.col("submitted_at").alias("observed_at"),
    )
    told = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("website", "description", "stage")]
    return out.where("name <> ''").withColumn("claims", told[0] + told[1] + told[2])
