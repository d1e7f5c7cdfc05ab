"""Word shingles of many texts at a time, in numpy.

A word is a run of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased. Each word has a 64-bit polynomial hash over a table of
random byte values, mixed; a shingle hash combines the hashes of its words in order, mixed again. All texts of a batch
lie in one buffer, so the work is a fixed number of passes over bytes and words, whatever the lengths of the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WORDS = 5
#: Bytes of text hashed at once: it bounds the memory of a task.
BLOCK = 1_000_000

_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BASE = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_table = {"up": _powers(BASE, 1), "down": _powers(INVERSE, 1)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_table["up"]) < n:
        m = max(n, BLOCK + 1)
        up, down = _powers(BASE, m), _powers(INVERSE, m)
        if m > 4 * BLOCK:
            return up, down
        _table.update(up=up, down=down)
    return _table["up"], _table["down"]


@dataclass
class Words:
    """Hashes of the words of several texts; those of text i are hashes[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray


def words(texts: list[str | None]) -> Words:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    blank = IS_BLANK[buf]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * STEP)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    return Words(hashes, np.searchsorted(begins, starts))


def shingles(w: Words, size: int = WORDS) -> Words:
    """The shingles of each text in order; a text of fewer words has one, of all its words; a text without words has none."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    if len(w.hashes) >= size:
        acc = w.hashes[: len(w.hashes) - size + 1].copy()
        for k in range(1, size):
            acc *= STEP
            acc += w.hashes[k : len(w.hashes) - size + 1 + k]
        run = mix(acc)
    else:
        run = np.empty(0, dtype=np.uint64)
    out = np.empty(first[-1], dtype=np.uint64)
    full = n >= size
    if full.any():
        at = np.repeat(w.first[:-1][full] - first[:-1][full], count[full]) + np.concatenate([np.arange(a, b) for a, b in zip(first[:-1][full], first[1:][full], strict=True)])
        keep = np.repeat(full, count)
        out[keep] = run[at]
    for i in np.flatnonzero((n > 0) & ~full):
        acc = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in w.hashes[w.first[i] : w.first[i + 1]]:
                acc = acc * STEP + h
            out[first[i]] = mix(np.array([acc + np.uint64(n[i])]))[0]
    return Words(out, first)


def rows_of(batch: pa.RecordBatch, columns: int) -> Iterator[tuple]:
    """The rows of the first columns of a batch, a few at a time, so that a task holds few of them as Python values."""
    for at in range(0, batch.num_rows, 200):
        part = batch.slice(at, 200)
        yield from zip(*[part.column(i).to_pylist() for i in range(columns)], strict=True)


def blocks(rows: Iterable[tuple], text_at: int) -> Iterator[list[tuple]]:
    """Rows in groups of about BLOCK characters; a longer text makes a group of its own."""
    group, size = [], 0
    for row in rows:
        n = len(row[text_at] or "")
        if group and size + n > BLOCK:
            yield group
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield group
