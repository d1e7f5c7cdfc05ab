"""Target-distribution importance resampling (12): documents are drawn by how much their word runs look like a target's.

Features are the runs of 1 to `runs` consecutive words, repeats counted, hashed by crc32 into BUCKETS. The gain of a bucket is
the log ratio of its smoothed shares in the target and in the corpus; a document's weight is the sum over its features, and
Gumbel noise, fixed by id and seed, makes the highest scores a draw without replacement.

Long texts are skewed work: a text of more than CHUNK bytes is split at word boundaries into chunks that carry runs - 1 words
of the next one, so that each run belongs to the chunk that holds its first word. Chunks are dealt anew over all tasks; their
counts and weights are summed by document. Each text is read twice (the long ones apart), hashed once; from then on there are only counts of buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import materialize
from tracefold.llm.shingles import rows_of

BUCKETS = 10_000
CHUNK = 64_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT, SEED = 10, 2024

#: A-Z lower-cased; every ASCII character but digits and letters parts words.
WORD_BYTES = bytes((i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32) for i in range(256))

CHUNKS = "row long, long boolean, id long, text binary, own int"
COUNTED = pa.schema([("row", pa.int64()), ("long", pa.bool_()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
COUNTED_DDL = "row long, long boolean, id long, n_words long, n_features long, buckets binary, counts binary"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


_NEXT = re.compile(rb" *[^ ]+")


def chunks_of(text: str, runs: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(words of a chunk with those it carries, number of its own words). A word longer than a chunk stays whole."""
    raw, at = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES), 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = tail = end if end >= 0 else len(raw)
        for _ in range(runs - 1):
            after = _NEXT.match(raw, tail)
            tail = after.end() if after else len(raw)
        yield raw[at:tail], len(raw[at:end].split())
        at = end


def _split(runs: int, size: int):
    schema = pa.schema([("row", pa.int64()), ("long", pa.bool_()), ("id", pa.int64()), ("text", pa.binary()), ("own", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in rows_of(batch, 3):
                for part, own in chunks_of(text, runs, size):
                    yield pa.RecordBatch.from_pydict({"row": [row], "long": [True], "id": [doc], "text": [part], "own": [own]}, schema=schema)

    return run


def feature_codes(words: list[bytes], own: int, runs: int) -> np.ndarray:
    """The buckets of all runs that begin at one of the first `own` words."""
    code = [zlib.crc32(w) for w in words]
    out, tails = [code[:own]], None
    for n in range(1, runs):
        # a run is a shorter one, a space and the next word
        tails = tails or [b" " + w for w in words]
        code = [zlib.crc32(t, c) for c, t in zip(code, tails[n:], strict=False)]
        out.append(code[:own])
    return np.concatenate([np.array(x, dtype=np.int64) for x in out]) % BUCKETS


def _count(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f.name: [] for f in COUNTED}
            for row, long, doc, text, own in rows_of(batch, 5):
                words = words_of(text or b"")
                own = len(words) if own is None else own
                codes = feature_codes(words, own, runs)
                buckets, counts = np.unique(codes, return_counts=True)
                for k, v in zip(out, (row, long, doc, own, len(codes), buckets.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=COUNTED)

    return run


def counted(docs: DataFrame, id_col: str, text_col: str, runs: int = 1, chunk: int = CHUNK) -> DataFrame:
    """A written row for each document of up to `chunk` bytes or chunk of a longer one: its words, its features, its buckets with counts."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > chunk
    short = base.where(~is_long).select("row", F.lit(False).alias("long"), "id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("int").alias("own"))
    long = base.where(is_long).select("row", "id", "text").mapInArrow(_split(runs, chunk), CHUNKS).repartition(F.xxhash64("row", "text"))
    count = lambda df: df.mapInArrow(_count(runs), COUNTED_DDL)
    return materialize(count(short).unionByName(count(long)), "bucket_counts")


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for buckets, counts in rows_of(batch, 2):
            total[np.frombuffer(buckets, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[at]}, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64())]))


def bucket_sums(table: DataFrame) -> DataFrame:
    """(bucket, n): at most BUCKETS rows; each task sums its own rows first."""
    return table.select("buckets", "counts").mapInArrow(_sum, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    spark = corpus.sparkSession
    c, t = bucket_sums(corpus).withColumnRenamed("n", "s"), bucket_sums(target).withColumnRenamed("n", "t")
    each = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(c, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    each = each.persist()
    size_s, size_t = (float(x or 0) for x in each.agg(F.sum("s"), F.sum("t")).first())
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * F.lit(size_s + BUCKETS)) / ((d("s") + 1) * F.lit(size_t + BUCKETS))
    rows = each.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    each.unpersist()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def _weigh(model):
    schema = pa.schema([("row", pa.int64()), ("long", pa.bool_()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = model.value
        for batch in batches:
            weight = [int(gain[np.frombuffer(b, dtype=np.uint16)] @ np.frombuffer(c, dtype=np.uint32).astype(np.int64)) for b, c in rows_of(batch.select(["buckets", "counts"]), 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in schema.names[:-1]), pa.array(weight, type=pa.int64())], schema=schema)

    return run


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """`rows` with rank, 1, 2, 3 ... by `order` (columns that set the score highest first, ids ascending), and their number.

    The rows are dealt by ranges of the order; a row's rank is its place in its range after all rows of the ranges before. Only
    the sizes of the ranges go through the driver.
    """
    by = [F.col(order[0]).desc(), *[F.col(c).asc() for c in order[1:]]]
    dealt = materialize(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("range").count().collect())
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "range int, before long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    return dealt.withColumn("place", place).join(offsets, "range").withColumn("rank", F.col("before") + F.col("place")).drop("range", "place", "before"), before


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", runs: int = 1, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of `docs`; rank is null where a row is not drawn.

    Of the N rows with an id and at least `least_words` words, the floor(percent * N / 100) of the highest scores are drawn,
    ties to the smaller id; equal rows of one id, which nothing parts, take ranks in any order. Null and empty texts have no
    feature and a weight of 0. A row without an id has no score and is never drawn, but its features count for the corpus.
    Ids are whole numbers; other columns are left out, whatever their names. An empty table gives an empty table.
    """
    corpus = counted(docs, id_col, text_col, runs)
    model = docs.sparkSession.sparkContext.broadcast(gains(corpus, counted(target, target_id, "text", runs)))
    weighed = corpus.mapInArrow(_weigh(model), "row long, long boolean, id long, n_words long, n_features long, weight long")
    numbers = ["n_words", "n_features", "weight"]
    parts = weighed.where("long").groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in numbers])
    each = weighed.where("NOT long").select("row", "id", *numbers).unionByName(parts)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(each.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    drawn, n = ranked(scored.where(able), ["score", "id", "row"])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("id", "n_features", "weight", "score", "rank")


def resampling_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return importance_resample(docs, target).withColumnRenamed("id", "doc_id")
