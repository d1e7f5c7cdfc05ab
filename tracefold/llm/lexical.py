"""Ranked lexical search (13): Block-Max WAND over an index of compressed posting blocks.

Documents are indexed where they are read, in segments of about SEGMENT bytes: the texts themselves are never shuffled. In a
segment the documents are numbered by length, so that neighbours are worth alike; the postings of a term lie in blocks of
BLOCK postings, byte-coded (gaps and counts), and each block has the largest impact of its postings. An index is a table,
with one row for each segment, in the shared folder.

A query looks at a segment in three moves. (1) From the first and last documents and the largest impacts of its terms' blocks,
all undecoded, follow the intervals between block borders and a bound for the score of every document in each of them: these
are WAND's shallow moves, made for all terms at once. (2) Intervals whose bound lies below the k-th best score so far are
skipped. (3) Of the rest, the most promising are decoded and scored first, the bar rises, and (2) is done again. The bar is
carried from segment to segment of a task, and before the whole index is read, a small share of its segments (LEADERS) sets a
bar for all tasks. Nothing that ties with the bar is skipped, so answers are exact.

Scores are integers: a term's weight times (10^9 tf) div (1000 tf + 8 m), where m grows with the length of the document. Terms
are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import materialize
from tracefold.llm.pieces import in_groups
from tracefold.llm.resampling import WORD_BYTES
from tracefold.llm.shingles import BYTE, STEP, _power_tables, mix, rows_of

K = 10
#: Bytes of text in a segment, postings in a block.
SEGMENT, BLOCK = 8_000_000, 128
#: One segment in so many is searched first.
LEADERS = 32
#: Terms of all items that are searched for in one pass over the index: what each task is sent.
TERMS_AT_ONCE = 200_000
#: Share of length in m, in hundredths.
LENGTH_SHARE = 90


def term_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the terms of piece i, in order, are hashes[first[i]:first[i + 1]]."""
    buf = np.frombuffer(b"".join(p.translate(WORD_BYTES) + b" " for p in parts), dtype=np.uint8)
    blank = buf == 32
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * STEP)
    return hashes, np.searchsorted(begins, np.cumsum([0] + [len(p) + 1 for p in parts]))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of a batch."""
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for owners, parts in in_groups(enumerate(t for (t,) in rows_of(batch, 1))):
            for i, p in zip(owners, parts, strict=True):
                word = np.frombuffer(p.translate(WORD_BYTES), dtype=np.uint8) != 32
                n[i] += int(word[:1].sum()) + int(np.count_nonzero(word[1:] & ~word[:-1]))
        yield pa.RecordBatch.from_pydict({"docs": [int(np.count_nonzero(n))], "terms": [int(n.sum())]})


# ---- byte code: seven bits a byte, the last byte of a value below 128


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place of the end of each value)."""
    width = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        width += values >= 1 << bits
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    rest = values.astype(np.int64)
    for k in range(int(width.max()) if len(width) else 0):
        on = np.flatnonzero(width > k)
        # the lowest seven bits are the last byte
        out[ends[on] - 1 - k] = (rest[on] & 127) | (128 if k else 0)
        rest[on] >>= 7
    return out, ends


def decode(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.repeat(last, last - first + 1) - np.arange(len(raw))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first) if len(last) else np.empty(0, dtype=np.int64)


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


SEGMENTS = [
    ("leader", pa.bool_()), ("ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()), ("df", pa.binary()), ("largest", pa.binary()),
    ("first_doc", pa.binary()), ("last_doc", pa.binary()), ("ends", pa.binary()), ("postings", pa.binary()),
]
SEGMENTS_DDL = ", ".join(f"{k} {'boolean' if k == 'leader' else 'binary'}" for k, _ in SEGMENTS)


class Building:
    """The documents of a segment so far: runs of (term, document, count), sorted by term in each part."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.total, self.ids, self.n, self.parts, self.bytes = docs, terms, [], [], [], 0

    def add(self, ids: list[int], owners: list[int], parts: list[bytes]) -> None:
        """Pieces of the texts of `ids`; owners are places in it, the first may go on from before."""
        hashes, first = term_hashes(parts)
        own = np.repeat(np.array(owners, dtype=np.int64), np.diff(first))
        order = np.lexsort((own, hashes))
        h, o = hashes[order], own[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))) if len(h) else np.empty(0, dtype=np.int64)
        self.parts.append((h[new], o[new], np.diff(np.append(new, len(h)))))
        self.bytes += sum(map(len, parts))

    def segment(self, ids: list[int]) -> dict | None:
        h, o, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if not len(h):
            return None
        n = np.bincount(o, weights=tf, minlength=len(ids)).astype(np.int64)
        by_length = np.lexsort((np.array(ids, dtype=np.int64), n))
        number = np.empty(len(ids), dtype=np.int64)
        number[by_length] = np.arange(len(ids))
        ids, n = np.array(ids, dtype=np.int64)[by_length], n[by_length]
        doc = number[o]
        order = np.lexsort((doc, h))
        h, doc, tf = h[order], doc[order], tf[order]
        # the pieces of a long text hold the same term each
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
        h, doc, tf = h[new], doc[new], np.add.reduceat(tf, new)
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        df = np.diff(np.append(begin, len(h)))
        blocks = -(-df // BLOCK)
        start = np.repeat(begin, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        last = np.append(start[1:], len(h)) - 1
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * self.docs) // self.total
        gap = np.diff(doc, prepend=0)
        gap[start] = doc[start]
        pairs = np.empty(2 * len(doc), dtype=np.int64)
        pairs[0::2], pairs[1::2] = gap, tf
        raw, ends = encode(pairs)
        return {
            "leader": bool(int(mix(ids[:1].view(np.uint64))[0]) % LEADERS == 0),
            "ids": ids.tobytes(), "lengths": n.tobytes(), "terms": h[begin].tobytes(), "df": df.astype(np.uint32).tobytes(),
            "largest": np.maximum.reduceat(worth(tf, m[doc]), start).astype(np.uint32).tobytes(),
            "first_doc": doc[start].astype(np.uint32).tobytes(), "last_doc": doc[last].astype(np.uint32).tobytes(),
            "ends": ends[2 * last + 1].astype(np.uint32).tobytes(), "postings": raw.tobytes(),
        }


def _index(docs: int, terms: int, size: int):
    schema = pa.schema(SEGMENTS)
    row = lambda s: pa.RecordBatch.from_pydict({k: [v] for k, v in s.items()}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at = [], Building(docs, terms)

        def texts() -> Iterator[tuple[int, str | None]]:
            for batch in batches:
                for doc, text in rows_of(batch, 2):
                    ids.append(doc)
                    yield len(ids) - 1, text

        base = 0
        for owners, parts in in_groups(texts()):
            # a segment ends before a document, never within one
            while at.bytes >= size and owners[0] - base == len(at.ids):
                if (s := at.segment(at.ids)) is not None:
                    yield row(s)
                base += len(at.ids)
                at = Building(docs, terms)
            at.ids = ids[base : owners[-1] + 1]
            at.add(at.ids, [o - base for o in owners], parts)
        if at.parts and (s := at.segment(at.ids)) is not None:
            yield row(s)

    return run


class Index:
    """A table of segments, with the numbers of documents and terms that its impacts rest on."""

    def __init__(self, table: DataFrame, docs: int, terms: int):
        self.table, self.docs, self.terms = table, docs, terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> Index:
    """The index of all rows with an id; a text that is null or has no term is no document. Ids are whole numbers; rows of one id stand for themselves."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    n, size = source.select("text").mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    table = source.mapInArrow(_index(n or 0, size or 1, segment), SEGMENTS_DDL)
    return Index(materialize(table, "segments"), n or 0, size or 1)


class Segment:
    """A row of the index, its postings undecoded."""

    def __init__(self, row: dict, docs: int, total: int):
        of = lambda k, t: np.frombuffer(row[k], dtype=t)
        self.ids, self.terms, self.df = of("ids", np.int64), of("terms", np.uint64), of("df", np.uint32).astype(np.int64)
        self.m = 100 - LENGTH_SHARE + (LENGTH_SHARE * of("lengths", np.int64) * docs) // total
        self.largest, self.first, self.last = (of(k, np.uint32).astype(np.int64) for k in ("largest", "first_doc", "last_doc"))
        self.ends, self.raw = of("ends", np.uint32).astype(np.int64), of("postings", np.uint8)
        self.block = np.concatenate(([0], np.cumsum(-(-self.df // BLOCK))))
        self.decoded = 0

    def _postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `blocks`, document, count) of all postings of the blocks."""
        self.decoded += len(blocks)
        begin, end = np.where(blocks > 0, self.ends[blocks - 1], 0), self.ends[blocks]
        width = end - begin
        at = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        raw = self.raw[at]
        pairs = decode(raw)
        # values up to the end of each block
        values = np.concatenate(([0], np.cumsum(raw < 128)))[np.cumsum(width)]
        n = np.diff(values, prepend=0) // 2
        doc, start = np.cumsum(pairs[0::2]), np.cumsum(n) - n
        doc -= np.repeat(doc[start] - pairs[0::2][start], n)
        return np.repeat(np.arange(len(blocks)), n), doc, pairs[1::2]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], bar: int) -> tuple[np.ndarray, np.ndarray]:
        """`best` (scores, ids; best first) with what this segment adds to the k best; `bar` is a score that the k-th best reaches anyhow."""
        at = np.searchsorted(self.terms, terms)
        known = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights > 0))
        if not len(known):
            return best
        begin, n = self.block[at[known]], self.block[at[known] + 1] - self.block[at[known]]
        blocks = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        weight = np.repeat(weights[known], n)
        first, last, top = self.first[blocks], self.last[blocks], weight * self.largest[blocks]
        borders = np.unique(np.concatenate((first, last + 1)))
        low, high = np.searchsorted(borders, first), np.searchsorted(borders, last + 1)
        steps = np.zeros(len(borders), dtype=np.int64)
        np.add.at(steps, low, top)
        np.subtract.at(steps, high, top)
        bound = np.cumsum(steps)
        order = np.argsort(-bound, kind="stable")
        at_once, done = 2, 0
        while True:
            floor = max(1, bar, int(best[0][k - 1]) if len(best[0]) >= k else 0)
            take = order[done : done + at_once]
            take = take[bound[take] >= floor]
            if not len(take):
                return best
            chosen = np.zeros(len(borders) + 1, dtype=np.int64)
            chosen[take + 1] = 1
            covers = np.cumsum(chosen)
            part = np.flatnonzero(covers[high] > covers[low])
            place, doc, tf = self._postings(blocks[part])
            inside = chosen[np.searchsorted(borders, doc, side="right")] == 1
            place, doc, tf = place[inside], doc[inside], tf[inside]
            score = np.zeros(len(self.ids), dtype=np.int64)
            np.add.at(score, doc, weight[part][place] * worth(tf, self.m[doc]))
            good = np.flatnonzero(score >= floor)
            scores, ids = np.concatenate((best[0], score[good])), np.concatenate((best[1], self.ids[good]))
            keep = np.lexsort((ids, -scores))[:k]
            best = scores[keep], ids[keep]
            done, at_once = done + at_once, at_once * 4


NONE = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def _search(sent, k: int, docs: int, total: int):
    """The k best of all segments of a task, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bars = sent.value
        best = [NONE] * len(queries)
        for row in _segments(batches):
            segment = Segment(row, docs, total)
            best = [segment.search(terms, weights, k, b, bar) for (terms, weights), b, bar in zip(queries, best, bars, strict=True)]
        for i, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, dtype=np.int32)), pa.array(ids), pa.array(scores)], schema=FOUND)

    return run


def _frequencies(sent):
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = sent.value, np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for terms, df in rows_of(batch, 2):
                terms, df = np.frombuffer(terms, dtype=np.uint64), np.frombuffer(df, dtype=np.uint32)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[at] == wanted, df[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[total > 0].view(np.int64)), pa.array(total[total > 0])], schema=schema)

    return run


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item", pa.int64()), ("terms", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for item, text in rows_of(batch, 2):
            found = [np.unique(term_hashes(parts)[0]) for _, parts in in_groups([(0, text)])]
            terms = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_pydict({"item": [item], "terms": [terms.tobytes()], "n": [len(terms)]}, schema=schema)


def _weights(index: Index, items: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """The terms of each item that some document holds, with their weights."""
    spark = index.table.sparkSession
    terms = [np.frombuffer(r.terms, dtype=np.uint64) for r in items]
    wanted = spark.sparkContext.broadcast(np.unique(np.concatenate(terms)))
    df = index.table.select("terms", "df").mapInArrow(_frequencies(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weigh = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    rows = np.array([(r.term, r.weight) for r in df.select("term", weigh.alias("weight")).collect()], dtype=np.int64).reshape(-1, 2)  # TERMS_AT_ONCE at most
    order = np.argsort(rows[:, 0].view(np.uint64))
    known, weight = rows[order, 0].view(np.uint64), rows[order, 1]
    out = []
    for t in terms:
        at = np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
        on = known[at] == t if len(known) else np.zeros(len(t), dtype=bool)
        out.append((t[on], weight[at[on]]))
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; first by salts, so that no task gets the answers of all tasks to a query."""
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def _search_block(index: Index, items: list, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of some items, TERMS_AT_ONCE terms in all or one item."""
    spark = index.table.sparkSession
    queries = _weights(index, items)
    bars = [0] * len(queries)
    look = lambda part: part.mapInArrow(_search(spark.sparkContext.broadcast((queries, list(bars))), k, index.docs, index.terms), "query int, doc_id long, score long")
    leaders = materialize(_best(look(index.table.where("leader")), k), "leaders")
    for query, score in leaders.where(F.col("rank") == k).select("query", "score").collect():
        bars[query] = score
    found = leaders.select("query", "doc_id", "score").unionByName(look(index.table.where("NOT leader")))
    names = F.broadcast(spark.createDataFrame([(i, r.item) for i, r in enumerate(items)], "query int, item long"))
    return _best(found, k).join(names, "query").select("item", "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(item, rank, doc_id, score): the k documents of the highest scores above 0 for each row of `items`, ties by the smaller id.

    An item with a null text or without a known term has no row; rows of one item id are answered each for itself, a null id stays null. Other
    columns of either table are left out, whatever their names. Items are searched in blocks of TERMS_AT_ONCE terms, which is what a
    task is sent; each block reads the index once. Empty tables give an empty table.
    """
    spark = index.table.sparkSession
    source = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    wanted = materialize(source.mapInArrow(_terms_of_items, "item long, terms binary, n long").where("n > 0"), "items")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // TERMS_AT_ONCE)
    part = F.pmod(F.xxhash64("terms"), F.lit(max(blocks, 1)))
    out = None
    for b in range(blocks):
        rows = sorted(wanted.where(part == b).select("item", "terms").collect(), key=lambda r: (r.item is None, r.item or 0, r.terms))
        found = _search_block(index, rows, k) if rows else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item long, rank int, doc_id long, score long")


def search_digest(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each item."""
    return search(build(docs), items, k=k).withColumnRenamed("item", "item_id")
