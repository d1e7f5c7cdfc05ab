"""Exact top-k search (2): incremental multi-index hashing of 64-bit codes.

A code is cut into SEGMENTS segments, each with a table from its value to the codes that have it. Codes within distance
SEGMENTS (r + 1) - 1 of a query lie within r of it in one segment at least. So a search looks up all segment values at
radius 0, 1, 2, ..., verifies what it finds by whole distance, and stops for a query once its k-th distance is covered.

Rows of one code are one entry, with the k smallest ids, which is all that a top k by distance and id can need: a code that
a third of all rows share costs no more than another. Entries are dealt to shards and query codes to blocks, both by hash;
each shard meets each block in a task, and the shards' answers, k ids for each query at most, are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import materialize

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
K = 10
#: Entries of a shard, and queries of a block: both are what a task holds.
SHARD, BLOCK = 250_000, 100_000
#: Look-ups that are made at once.
AT_ONCE = 1_000_000
#: Queries that are searched together within a block.
AT_A_TIME = 500


def _project(vectors: np.ndarray) -> np.ndarray:
    """Signs of 64 dimensions; vectors of other widths are turned by a fixed random matrix first."""
    if vectors.shape[1] != BITS:
        vectors = vectors @ np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], BITS)).astype(np.float32)
    return (vectors > 0).astype(np.uint8)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("code", pa.int64())])
    for batch in batches:
        ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if ids[i] is not None and v and None not in v:
                by_width.setdefault(len(v), []).append(i)
        for rows in by_width.values():
            bits = _project(np.array([vectors[i] for i in rows], dtype=np.float32))
            codes = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], type=pa.int64()), pa.array(codes)], schema=schema)


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit d of a code is set where dimension d is above 0. Rows without id or vector, or with a null in it, go."""
    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<float>")).mapInArrow(_encode, "id long, code long")


def _masks() -> list[np.ndarray]:
    """All segment values of each number of set bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], dtype=np.uint64) for r in range(WIDTH + 1)]


class MultiIndex:
    """The segment tables of some codes, each with the number of its ids, k at most."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, self.sizes, self.masks = codes, sizes, _masks()
        self.tables = []
        for s in range(SEGMENTS):
            value = self._segment(codes, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange(2**WIDTH + 1))))

    @staticmethod
    def _segment(codes: np.ndarray, s: int) -> np.ndarray:
        return (codes >> np.uint64(WIDTH * s)) & np.uint64(2**WIDTH - 1)

    def _at_radius(self, queries: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the query, place of the code) for every code within exactly r in some segment, in parts."""
        masks = self.masks[r]
        step = max(1, AT_ONCE // len(masks))
        for s in range(SEGMENTS):
            order, starts = self.tables[s]
            for at in range(0, len(queries), step):
                probes = (self._segment(queries[at : at + step], s)[:, None] ^ masks[None, :]).ravel().astype(np.int64)
                first, n = starts[probes], starts[probes + 1] - starts[probes]
                full = np.flatnonzero(n)
                total = int(n[full].sum())
                if total:
                    shift = np.repeat(first[full] - np.concatenate(([0], np.cumsum(n[full])[:-1])), n[full])
                    yield np.repeat(full // len(masks) + at, n[full]), order[np.arange(total) + shift]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance), as places, of enough codes for the k nearest ids of each query, ties included."""
        open_ = np.arange(len(queries))
        need = min(k, int(self.sizes.sum()))
        found = [np.empty(0, dtype=np.int64)] * 3
        for r in range(WIDTH + 1):
            q, c, d = [found[0]], [found[1]], [found[2]]
            for i, j in self._at_radius(queries[open_], r):
                q.append(open_[i])
                c.append(j)
                d.append(np.bitwise_count(queries[open_[i]] ^ self.codes[j]).astype(np.int64))
            q, c, d = map(np.concatenate, (q, c, d))
            order = np.lexsort((c, d, q))
            q, c, d = q[order], c[order], d[order]
            new = np.concatenate(([True], (q[1:] != q[:-1]) | (c[1:] != c[:-1]))) if len(q) else np.empty(0, dtype=bool)
            q, c, d = q[new], c[new], d[new]
            # ids up to each entry of a query: entries behind its k-th distance are of no use
            ids = np.cumsum(self.sizes[c])
            begin = np.searchsorted(q, np.arange(len(queries)))
            before = ids - np.repeat((ids - self.sizes[c])[np.minimum(begin, max(len(q) - 1, 0))], np.diff(np.append(begin, len(q)))) if len(q) else ids
            kth = np.full(len(queries), BITS + 1)
            enough = np.flatnonzero(before >= need)
            np.minimum.at(kth, q[enough], d[enough])
            keep = d <= kth[q]
            found = [q[keep], c[keep], d[keep]]
            open_ = open_[kth[open_] > SEGMENTS * (r + 1) - 1]
            if not len(open_):
                break
        return tuple(found)


ANSWER = "query long, distance int, vec_id long"


def _search(k: int):
    """The k nearest ids in one shard for each query of one block, by distance and id."""
    schema = pa.schema([("query", pa.int64()), ("distance", pa.int32()), ("vec_id", pa.int64())])

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        if not entries.num_rows or not asked.num_rows:
            return schema.empty_table()
        codes = entries.column("code").to_numpy().view(np.uint64)
        wanted = asked.column("code").to_numpy().view(np.uint64)
        lists = entries.column("ids").combine_chunks()
        sizes, ids = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        index, out = MultiIndex(codes, sizes), []
        for at in range(0, len(wanted), AT_A_TIME):
            q, c, d = index.search(wanted[at : at + AT_A_TIME], k)
            n = sizes[c]
            place = np.repeat(starts[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            q, d, i = np.repeat(q, n), np.repeat(d, n), ids[place]
            order = np.lexsort((i, d, q))
            q, d, i = q[order], d[order], i[order]
            near = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append(pa.Table.from_arrays([pa.array(wanted[at : at + AT_A_TIME][q[near]].view(np.int64)), pa.array(d[near].astype(np.int32)), pa.array(i[near])], schema=schema))
        return pa.concat_tables(out)

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of `codes` (id, code) for each row of `queries` (id, code).

    Nearest by Hamming distance, then by id; a query that is a row itself is among its own answers. Fewer rows than k: all
    of them. Repeated rows of one id and code count once, rows without id or code not at all. Empty tables give an empty
    table. Every shard meets every block of queries in a task of its own; nothing of either goes through the driver.
    """
    entries = materialize(_smallest(codes.where("id IS NOT NULL AND code IS NOT NULL"), k), "entries")
    queries = queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    asked = materialize(queries.select("code").distinct(), "asked")
    shards, blocks = max(4, -(-entries.count() // SHARD)), max(1, -(-asked.count() // BLOCK))
    part = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df: df.repartition(shards * blocks, "shard", "block").groupBy("shard", "block")
    left = dealt(entries.select("code", "ids", part(shards).alias("shard"), every(blocks).alias("block")))
    right = dealt(asked.select("code", part(blocks).alias("block"), every(shards).alias("shard")))
    found = left.cogroup(right).applyInArrow(_search(k), ANSWER)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query_id"), "code").join(ranked, F.col("code") == F.col("query")).select("query_id", "rank", "vec_id", "distance")


def _smallest(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each code. Ids are first thinned by salt, so that no task gets all rows of a code."""
    salted = codes.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("n") <= k)
    return few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))


#: Every row whose id is divisible by this is a query.
EVERY = 20


def top_k_digest(vectors: DataFrame, k: int = K) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by 20, among all rows."""
    codes = materialize(binary_codes(vectors), "codes")
    return top_k(codes, codes.where(F.col("id") % EVERY == 0), k)
