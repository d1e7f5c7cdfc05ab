"""Best-fit packing (4): bulk-synchronous best-fit over sorted runs of lengths.

Pieces of one length are alike, and so are sequences with one history, so the range-sorted pieces and the range-sorted gaps
are both kept as runs: (length, how many) and (gap, how many). A round takes the longest pieces still waiting and sweeps
the gaps upwards from the successor of that length; the pieces, ranked, take places gap by gap, each sequence as many as
fit; runs that are taken in part are split; what finds no gap opens new sequences; the gaps are updated and the next round
begins. There are at most `capacity` lengths, hence rounds, and at most four runs more for each, however many documents
there are; the runs are all that the driver holds.

The pieces themselves stay distributed: each gets its rank among those of its length (from counts by length and salt), and
the rank says which sequence of which run it has, and where.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import materialize
from tracefold.llm.shingles import blocks, rows_of
from tracefold.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for group in blocks(rows_of(batch, 2), 1):
                rows = []
                for (doc, _), ids in zip(group, enc.encode([g[1] for g in group]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def cut_pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: their ids, closed by `end_id`, cut after every `capacity`."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_cut(path or tokenizer_path(), end_id, capacity), PIECES)


@dataclass
class Run:
    """`count` sequences that hold the same lengths in the same order, numbered from `number` on."""

    number: int
    count: int
    gap: int
    #: (length, rank of the first piece among those of its length, pieces in each sequence, offset of the first piece)
    held: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, count: int) -> Run:
        """Keep the first `count` sequences, return the others."""
        rest = Run(self.number + count, self.count - count, self.gap, [(n, rank + count * each, each, at) for n, rank, each, at in self.held])
        self.count = count
        return rest

    def take(self, length: int, rank: int, each: int, capacity: int) -> None:
        self.held.append((length, rank, each, capacity - self.gap))
        self.gap -= each * length


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """The runs of all sequences, for the number of pieces of each length: best fit, longest first."""
    runs: list[Run] = []
    gaps: list[tuple[int, int]] = []  # (gap, place in runs), in order
    number = 0

    def keep(run: Run) -> None:
        runs.append(run)
        if run.gap:
            insort(gaps, (run.gap, len(runs) - 1))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(gaps, (length, -1))  # the successor: the narrowest gap that is wide enough
            if at < len(gaps):
                place = gaps.pop(at)[1]
                run, runs[place] = runs[place], Run(0, 0, 0)
            else:
                run = Run(number, -(-left // (capacity // length)), capacity)
                number += run.count
            each = run.gap // length
            whole = min(run.count, left // each)
            last = left - whole * each if whole < run.count else 0
            if run.count > whole + (last > 0):
                keep(run.split(whole + (last > 0)))
            if last:
                part = run.split(whole)
                part.take(length, rank + whole * each, last, capacity)
                keep(part)
            if whole:
                run.take(length, rank, each, capacity)
                keep(run)
            left -= whole * each + last
            rank += whole * each + last
    return [r for r in runs if r.count]


def _placed(plan):
    """Sequence and offset of each piece, from its length and its rank among those of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, each, number, offset = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # ranks are far below 2^40, so length and rank make one ordered key
            i = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            within = rank - ranks[i]
            sequence = number[i] + within // each[i]
            at = offset[i] + within % each[i] * length
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(at))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset; the pieces of a sequence fill it from 0 without a gap."""
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    lengths = materialize(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in lengths.collect()}  # at most `capacity` rows
    plan = [(length << 40 | rank, rank, each, r.number, at) for r in best_fit(histogram, capacity) for length, rank, each, at in r.held]
    plan = spark.sparkContext.broadcast(np.array(sorted(plan), dtype=np.int64).reshape(-1, 5).T.copy())
    # the n pieces of a length are ranked in the square root of n parts, so that parts and their sums stay alike in size
    salts = lengths.select("length", F.ceil(F.sqrt("n")).alias("salts"))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("salt"))
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", (upto - F.col("n")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = salted.withColumn("nth", nth).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(plan), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document row: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of `end_id` alone. Repeated rows and rows without an id are packed each on their own.
    Only longer documents than `capacity` are cut. Pieces of one length are alike: which of them lies in which of the places
    for their length depends on the order of the rows. Other columns are not read; an empty table gives an empty table.
    A task holds the ids of one document, whatever its length, beside a block of shorter ones.
    """
    return pack(cut_pieces(docs, path, end_id, capacity, id_col, text_col), capacity)
