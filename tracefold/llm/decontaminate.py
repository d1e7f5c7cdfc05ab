"""Benchmark decontamination (6): size-partitioned MinHash containment search.

Short items hide in long documents, where their share of the whole is tiny. So items are parted by the size of their
shingle sets, into classes of sizes from u/2 to u, and for each class a document is cut into overlapping windows of 2u
shingles, one every u: each run of u shingles lies whole in some window, and an item in it makes up a quarter of the
window at least. Windows and items keep the minimum and the maximum of each of 32 permutations; an item and a document that
agree on one of these 64 values are a candidate pair, which the full sets then confirm. An item that a window holds whole
is missed with a probability below 0.75^64 = 1e-8, one of which it holds three quarters with 5e-6.

Window minima of all classes come from one pass over the shingles: those of larger classes are minima of smaller ones.

An item of fewer words than a shingle is one run of all its words, and is sought among the runs of as many words in the
documents, from LEAST_WORDS words on. An item of one or two words is only found in a document of just these words: else every
document that uses a common word would hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracefold.llm.shingles import WORDS, Words, blocks, rows_of, shingles, words

PERMUTATIONS = 32
#: An item is found in a document that holds so many hundredths of its shingles.
CONTAINED = 75
#: The fewest words of an item that is sought inside longer documents.
LEAST_WORDS = 3
#: Items that are searched in one pass over the documents; it bounds the index that is sent to the tasks.
ITEMS = 50_000
#: Bits of the table that turns away most window values before the exact look-up.
TABLE_BITS = 22

_rng = np.random.default_rng(23)
FACTORS = _rng.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPREAD = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)


def _cell(values: np.ndarray, k: int, kind: int) -> np.ndarray:
    return ((values + np.uint64(2 * k + kind)) * SPREAD) >> np.uint64(64 - TABLE_BITS)


@dataclass
class SizeClass:
    """The items of sizes from u/2 to u - 1 with the signature values they are found by."""

    u: int
    items: np.ndarray
    #: For each permutation and each of minimum and maximum: values in order, and the items they belong to.
    values: list[list[np.ndarray]]
    owners: list[list[np.ndarray]]
    table: np.ndarray


@dataclass
class Index:
    ids: list
    sets: list[np.ndarray]
    classes: list[SizeClass]
    #: For each number of words below that of a shingle: the hashes of such items in order, and the items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build_index(rows: list[tuple]) -> Index:
    """The index of some items (id, text). Items without words are in no class and never found."""
    w = words([r[1] for r in rows])
    s = shingles(w)
    sets = [np.unique(s.hashes[a:b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
    by_class: dict[int, list[int]] = {}
    by_words: dict[int, list[int]] = {}
    for i, (x, n) in enumerate(zip(sets, np.diff(w.first).tolist(), strict=True)):
        if LEAST_WORDS <= n < WORDS:
            by_words.setdefault(n, []).append(i)
        elif len(x):
            by_class.setdefault(2 ** len(x).bit_length(), []).append(i)
    classes = []
    for u, items in sorted(by_class.items()):
        table = np.zeros(2**TABLE_BITS, dtype=bool)
        values, owners = [], []
        for k in range(PERMUTATIONS):
            ends = [np.array([f(sets[i] * FACTORS[k]) for i in items], dtype=np.uint64) for f in (np.min, np.max)]
            orders = [np.argsort(e, kind="stable") for e in ends]
            values.append([e[o] for e, o in zip(ends, orders, strict=True)])
            owners.append([np.array(items)[o] for o in orders])
            for kind in (0, 1):
                table[_cell(ends[kind], k, kind)] = True
        classes.append(SizeClass(u, np.array(items), values, owners, table))
    short = {}
    for n, items in sorted(by_words.items()):
        hashes = shingles(words([rows[i][1] for i in items]), n).hashes
        order = np.argsort(hashes, kind="stable")
        short[n] = hashes[order], np.array(items)[order]
    return Index([r[0] for r in rows], sets, classes, short)


def short_matches(w: Words, index: Index) -> list[tuple[int, int, int]]:
    """(text, item, 1) of the items of few words that stand in a row in a text."""
    out = set()
    for n, (hashes, items) in index.short.items():
        run = shingles(w, n)
        left, right = np.searchsorted(hashes, run.hashes, "left"), np.searchsorted(hashes, run.hashes, "right")
        for at in np.flatnonzero(left < right):
            text = int(np.searchsorted(run.first, at, "right")) - 1
            # the one run of a shorter text is no run of n words
            if w.first[text + 1] - w.first[text] >= n:
                out.update((text, int(i), 1) for i in items[left[at] : right[at]])
    return sorted(out)


def _starts(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of `step` elements start that cut each run first[i]:first[i + 1], and the first cell of each run."""
    n = np.diff(first)
    cells = -(-n // step)
    at = np.concatenate(([0], np.cumsum(cells)))
    return np.repeat(first[:-1] - at[:-1] * step, cells) + np.arange(at[-1]) * step, at


def candidates(s: Words, index: Index) -> set[tuple[int, int]]:
    """(document, item) pairs that agree on a value of a window."""
    if not index.classes or not len(s.hashes):
        return set()
    unit = index.classes[0].u
    starts, first = _starts(s.first, unit)
    grouped = [(c, *_starts(first, c.u // unit)) for c in index.classes]
    docs = [np.repeat(np.arange(len(f) - 1), np.diff(f)) for _, _, f in grouped]
    found: set[tuple[int, int]] = set()
    for k in range(PERMUTATIONS):
        p = s.hashes * FACTORS[k]
        for kind, least in ((0, np.minimum), (1, np.maximum)):
            units = least.reduceat(p, starts)
            for (c, at, _), doc in zip(grouped, docs, strict=True):
                cells = least.reduceat(units, at) if c.u > unit else units
                window = cells.copy()
                same = doc[1:] == doc[:-1]
                window[:-1][same] = least(cells[:-1][same], cells[1:][same])
                hit = np.flatnonzero(c.table[_cell(window, k, kind)])
                if hit.size:
                    left = np.searchsorted(c.values[k][kind], window[hit], "left")
                    right = np.searchsorted(c.values[k][kind], window[hit], "right")
                    for h, a, b in zip(hit[left < right], left[left < right], right[left < right], strict=True):
                        found.update((int(doc[h]), int(i)) for i in c.owners[k][kind][a:b])
    return found


def matches(texts: list[str | None], index: Index) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of all items that the texts hold, confirmed on full sets."""
    w = words(texts)
    s = shingles(w)
    out = short_matches(w, index)
    held: dict[int, np.ndarray] = {}
    for d, i in sorted(candidates(s, index)):
        if d not in held:
            held = {d: np.unique(s.hashes[s.first[d] : s.first[d + 1]])}
        shared = len(np.intersect1d(held[d], index.sets[i], assume_unique=True))
        if 100 * shared >= CONTAINED * len(index.sets[i]):
            out.append((d, i, shared))
    return sorted(out)


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    rows = map(tuple, benchmark.select(id_col, text_col).toLocalIterator())
    while block := list(islice(rows, ITEMS)):
        yield build_index(block)


PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64())])


def _pairs(index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            for group in blocks(rows_of(batch, 2), 1):
                rows = [(group[d][0], x.ids[i], n, len(x.sets[i])) for d, i, n in matches([g[1] for g in group], x)]
                yield pa.RecordBatch.from_pylist([dict(zip(PAIRS.names, r, strict=True)) for r in rows], schema=PAIRS)

    return run


def _clean(index, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for group in blocks(((i, t) for i, (t,) in enumerate(rows_of(batch.select([text_at]), 1))), 1):
                for d, _, _ in matches([g[1] for g in group], x):
                    keep[group[d][0]] = False
            yield batch.filter(pa.array(keep))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): each document row with each benchmark item of which it holds CONTAINED %.

    Sets hold distinct 5-word shingles, A-Z lower-cased, or the whole sequence of fewer words. An item of three or four words
    is held by a document that says them in a row, one of one or two words by a document of just these words. Null and empty texts hold nothing; items without words
    are in no document; a null id stays null; repeated rows give repeated pairs. Other columns are not read; empty tables
    give an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long"), text_col)
    out = spark.createDataFrame([], "doc_id long, item_id long, shared long, item_shingles long")
    for n, index in enumerate(_indexes(benchmark.select(benchmark[item_col].cast("long").alias(item_col), item_text_col), item_col, item_text_col)):
        pairs = source.mapInArrow(_pairs(spark.sparkContext.broadcast(index)), out.schema)
        out = out.unionByName(pairs) if n else pairs
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, as `contaminated` finds them, with all their columns."""
    spark = docs.sparkSession
    for index in _indexes(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(index), docs.columns.index(text_col)), docs.schema)
    return docs
