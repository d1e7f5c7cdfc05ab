"""Names that may be spellings of one another, by keys that only near spellings have in common.

A part of a name is common to a share of all names, so pairs that meet on one grow with the square of the table. Here names
meet on what is left of them after as many characters are taken out as the bound allows: that is nearly the whole name, so
what meets is nearly what is accepted, and a name makes a number of keys that depends on its length alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.names import SIMILAR, SIMILAR_LENGTH, dice_of_many
from tracefold.shared import swept

#: The longest name that makes such keys: it may have lost three characters; the keys of longer ones would be too many.
LONGEST = 24
#: Keys of one array in a task.
AT_ONCE = 400_000
#: Entries (a key and whose it is) that a task packs at once, and that one task pairs.
PACKED, ENTRIES_A_TASK = 1_000_000, 2_000_000
#: Places that entries are dealt to, for each task: several, so that tasks are of nearly one size.
PLACES_A_TASK = 4
#: Entries that are shuffled in one round.
ENTRIES_A_ROUND = 600_000_000
#: Candidates of one array in a task, and those that one task checks.
CANDIDATES, CANDIDATES_A_TASK = 1_000_000, 1_000_000
#: Bits of a name's pairs of characters beside its key; five bits hold their number.
BITS = 59
#: Characters that are told apart where a name lost them; others count as different from all.
TOLD_APART = "abcdefghijklmnopqrstuvwxyz01234"
#: Pairs of characters are ordered by how often their part of so many comes up.
CELLS = 1 << 16
#: How many pairs of characters, the rarest shared ones, make a key, by how many the two names may differ in.
TAKEN = {0: 12, 1: 9, 2: 7, 3: 5}
FEWEST_TAKEN = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOLD = np.array(sorted(map(ord, TOLD_APART)), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edits_of(longer: int) -> int:
    """The most edits between names of similarity SIMILAR, by the length of the longer one."""
    return int((1 - SIMILAR) * longer + 1e-9)


def shared_of(a: int, b: int) -> int:
    """The fewest pairs of characters that names of Dice SIMILAR share, by their numbers of pairs."""
    return int(np.ceil(SIMILAR * (a + b) / 2 - 1e-9))


def _by_length(names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the names of one length at a time."""
    lengths = np.array([len(x) for x in names])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, np.array([names[i] for i in at], dtype=f"<U{size}").view(np.uint32).reshape(len(at), size).astype(np.uint64)


def _left_over(size: int) -> Iterator[tuple[str, int, Callable]]:
    """Keys for edits: a name without some characters, for each length of the longer name of a pair.

    Of a name of m characters at least m - e stand whole in a partner that is e edits away and no longer, so both can be
    brought to the same m - e characters. Each kind of key with its number and how it is made, with a word that says what was
    taken out: up to three times the gap (from 1, five bits) and the character (five bits), and in the highest two bits how many
    it were if that is just what a name of this length may differ in. What was taken out before all that is left is not named.
    """
    kept = {m - edits_of(m) for m in range(size, LONGEST + 1)}
    for r in sorted(k for k in kept if k <= size):
        places = np.array(list(combinations(range(size), r)), dtype=np.intp)
        out = np.array([sorted(set(range(size)) - set(p)) for p in places.tolist()], dtype=np.intp).reshape(len(places), size - r)
        gaps = (out - np.arange(size - r)).astype(np.uint32)  # how many of those that are left stand before
        most = np.uint32((size - r if size - r == edits_of(size) else 0) << 30)

        def make(codes: np.ndarray, r: int = r, places: np.ndarray = places, out: np.ndarray = out, gaps: np.ndarray = gaps, most: np.uint32 = most) -> tuple[np.ndarray, np.ndarray]:
            key = np.full((len(codes), len(places)), r, dtype=np.uint64)
            for c in range(r):
                key = key * _ODD + codes[:, places[:, c]]
                key ^= key >> np.uint64(29)
            told = np.searchsorted(_TOLD, codes).clip(0, len(_TOLD) - 1)
            told = np.where(_TOLD[told] == codes, told, 31).astype(np.uint32)
            word = np.full((len(codes), len(places)), most, dtype=np.uint32)
            for c in range(out.shape[1]):
                word |= np.where(gaps[:, c] > 0, gaps[:, c] << np.uint32(5) | told[:, out[:, c]], np.uint32(0)) << np.uint32(10 * c)
            return _mixed(key), word.astype(np.uint64)

        yield f"left {r}", len(places), make


def _numbered(codes: np.ndarray) -> np.ndarray:
    """A number for each pair of characters, another for each further time that it stands in the name."""
    grams = (codes[:, :-1] << np.uint64(21)) | codes[:, 1:]
    again = np.zeros(grams.shape, dtype=np.uint64)
    for i in range(1, grams.shape[1]):
        again[:, i] = (grams[:, :i] == grams[:, i : i + 1]).sum(1)
    return _mixed(_mixed(grams) + again)


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams % np.uint64(CELLS)).astype(np.intp)


def _ordered(grams: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Numbers of a name's pairs of characters, the rarest first."""
    # the order is the identity: what ties in it is one pair of characters for both names
    return _mixed(np.sort((often[_cell(grams)] << np.uint64(33)) | (grams >> np.uint64(31)), axis=1))


def _rarest_shared(size: int) -> Iterator[tuple[str, int, Callable]]:
    """Keys for Dice, of names of so many pairs of characters: for each number of pairs that a partner may have, the sets that may be the rarest of what both share.

    With o of n pairs shared, the j rarest shared ones are among the first n - o + j in the common order. Each kind of key
    with its number and how it is made from the ordered pairs.
    """
    for other in range(SIMILAR_LENGTH, LONGEST):
        shared = shared_of(size, other)
        if shared > min(size, other):
            continue
        taken = min(TAKEN.get(max(size, other) - shared, FEWEST_TAKEN), shared)
        first, lengths = size - shared + taken, (min(size, other), max(size, other))
        ways = list(combinations(range(first), size - shared))
        left_out = np.array(ways, dtype=np.intp).reshape(len(ways), size - shared)

        def make(values: np.ndarray, first: int = first, left_out: np.ndarray = left_out, lengths: tuple[int, int] = lengths) -> np.ndarray:
            values = values[:, :first]
            sums = np.repeat(values.sum(1, dtype=np.uint64)[:, None], len(left_out), axis=1)
            for c in range(left_out.shape[1]):
                sums -= values[:, left_out[:, c]]
            return _mixed(sums * _ODD + np.uint64(64 * lengths[0] + lengths[1]))

        yield f"shared {lengths[0]} {lengths[1]}", len(ways), make


def _kinds(length: int) -> dict[str, int]:
    """The kinds of keys of a name of so many characters, and how many of each."""
    out = {kind: n for kind, n, _ in _left_over(length)}
    return out | ({kind: n for kind, n, _ in _rarest_shared(length - 1)} if length > SIMILAR_LENGTH else {})


def _rounds(lengths: dict[int, int]) -> list[tuple[set[str], int]]:
    """Kinds of keys, all for edits or all for Dice, that are shuffled together, with the number of their entries, by how many names have each length."""
    total: dict[str, int] = {}
    for length, names in lengths.items():
        for kind, n in _kinds(length).items():
            total[kind] = total.get(kind, 0) + n * names
    out: list[tuple[set[str], int]] = []
    for kind, n in sorted(total.items(), key=lambda x: (-x[1], x[0])):
        sort = kind.split()[0]
        fits = next((i for i, (kinds, m) in enumerate(out) if m + n <= ENTRIES_A_ROUND and sort == next(iter(kinds)).split()[0]), None)
        if fits is None:
            out.append(({kind}, n))
        else:
            out[fits] = (out[fits][0] | {kind}, out[fits][1] + n)
    return out


def _near(kinds: set[str]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return _by_edits if next(iter(kinds)).startswith("left") else _by_pairs


def _packed(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """(place, high, data): entries by the place that their key falls to; what varies little lies together, so that it is compressed."""
    for high in np.unique(ids >> 32):
        at = np.flatnonzero(ids >> 32 == high)
        at = at[np.argsort(keys[at])]
        at = at[np.concatenate([[True], (keys[at[1:]] != keys[at[:-1]]) | (ids[at[1:]] != ids[at[:-1]]) | (words[at[1:]] != words[at[:-1]])])]
        spread = (keys[at] >> np.uint64(16)) * np.uint64(places)
        place = (spread >> np.uint64(48)).astype(np.int64)
        parts = np.stack([((spread >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype("<u4"), (ids[at] & 0xFFFFFFFF).astype("<u4"), (words[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), (words[at] >> np.uint64(32)).astype("<u4")])
        planes = parts.view(np.uint8).reshape(4, len(at), 4)
        ends = np.flatnonzero(np.diff(place, append=-1)) + 1
        begins = np.concatenate([[0], ends[:-1]])
        data = [planes[:, i:j].transpose(0, 2, 1).tobytes() for i, j in zip(begins, ends, strict=True)]
        yield pa.record_batch({"place": pa.array(place[begins].astype(np.int32)), "high": pa.array(np.full(len(begins), high, dtype=np.int64)), "data": pa.array(data, pa.binary())})


def _entries(wanted: set[str], often: np.ndarray, places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed entries of (n, key) rows, a bounded number at a time, of the kinds that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step, makers = max(1, AT_ONCE // 2048), {}
        for batch in batches:
            n = batch.column("n").to_numpy()
            for at, every in _by_length(batch.column("key").to_pylist()):
                size = every.shape[1]
                if size not in makers:
                    makers[size] = [[m for m in ms if m[0] in wanted] for ms in (_left_over(size), _rarest_shared(size - 1) if size > SIMILAR_LENGTH else ())]
                left, shared = makers[size]
                for i in range(0, len(at), step):
                    codes, ids = every[i : i + step], n[at[i : i + step]]
                    made = [make(codes) for _, _, make in left]
                    if shared:
                        grams = _numbered(codes)
                        values, bits = _ordered(grams, often), np.left_shift(np.uint64(1), grams % np.uint64(BITS))
                        words = np.bitwise_xor.reduce(bits, axis=1) << np.uint64(5) | np.uint64(size - 1)
                        made += [(keys, np.repeat(words[:, None], keys.shape[1], axis=1)) for keys in (make(values) for _, _, make in shared)]
                    held += [(keys.reshape(-1), np.repeat(ids, keys.shape[1]), words.reshape(-1)) for keys, words in made]
                    if sum(len(h[0]) for h in held) >= PACKED:
                        yield from _packed(*map(np.concatenate, zip(*held, strict=True)), places)
                        held = []
        if held:
            yield from _packed(*map(np.concatenate, zip(*held, strict=True)), places)

    return run


#: By the sum of their numbers of pairs of characters: in how many of them two names may differ.
_APART = np.array([n - 2 * shared_of(n, 0) for n in range(2 * LONGEST)])


def _by_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether names may be near by Dice: bits of either that the other has not are pairs of characters in which they differ."""
    return np.bitwise_count((x ^ y) >> np.uint64(5)) <= _APART[(x & np.uint64(31)) + (y & np.uint64(31))]


def _by_edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether names may be near by edits, by what each has lost in each gap, and should not meet on another key.

    Names within e edits have, of the ways to line them up with so few, one with the most characters left; its last ones are
    a key of both. There the losses of a gap cost the larger number, e in all at most, and no gap has lost one character in
    both: it could have stayed, with no more edits. (Only where all three of both are lost in one gap it might cost one more.)
    """
    x, y = x.astype(np.uint32), y.astype(np.uint32)
    lost = [[(w >> np.uint32(10 * c)) & np.uint32(1023) for c in range(3)] for w in (x, y)]
    gaps = [[v >> np.uint32(5) for v in side] for side in lost]
    # losses of one gap are numbered, so that those of the other name stand against one each
    nth = [[np.zeros(len(x), dtype=np.uint32), (g[1] == g[0]).astype(np.uint32), (g[2] == g[0]).astype(np.uint32) + (g[2] == g[1])] for g in gaps]
    slots = [[g * np.uint32(4) + k for g, k in zip(gs, ks, strict=True)] for gs, ks in zip(gaps, nth, strict=True)]
    cost = sum((g > 0).astype(np.int8) for side in gaps for g in side)
    same = np.zeros(len(x), dtype=bool)
    for i in range(3):
        there = gaps[0][i] > 0
        told = there & (lost[0][i] & np.uint32(31) != 31)
        for j in range(3):
            cost -= there & (slots[0][i] == slots[1][j])
            same |= told & (lost[0][i] == lost[1][j])
    one_gap = [(g[0] > 0) & (g[0] == g[1]) & (g[0] == g[2]) for g in gaps]
    return (cost <= np.maximum(x >> np.uint32(30), y >> np.uint32(30)).astype(np.int8)) & (~same | (one_gap[0] & one_gap[1]))


def _met(entries: list[tuple[int, bytes]], near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b: names of both sides, of one place, that have a key in common and may be near by what stands beside it."""
    planes = [(high, np.frombuffer(data, np.uint8).reshape(4, 4, -1)) for high, data in entries]
    parts = [np.ascontiguousarray(p.transpose(0, 2, 1)).view("<u4")[:, :, 0] for _, p in planes]
    key, low, word, more = (np.concatenate([p[i] for p in parts]) for i in range(4))
    word = word.astype(np.uint64) | more.astype(np.uint64) << np.uint64(32)
    n = np.concatenate([np.full(p.shape[1], high << 32, dtype=np.int64) for (high, _), p in zip(planes, parts, strict=True)]) | low
    order = (np.sort((key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.intp)
    key, n, word = key[order], n[order], word[order]
    at, d, found, held = np.arange(len(key)), 0, [], 0
    while len(at):
        d += 1
        at = at[: np.searchsorted(at, len(key) - d)]
        at = at[key[at] == key[at + d]]
        for i in range(0, len(at), CANDIDATES):
            x = at[i : i + CANDIDATES]
            y = x + d
            crossed = (n[x] & 1 & (n[y] >> 1)) | ((n[x] >> 1) & 1 & n[y])
            ok = (n[x] != n[y]) & (crossed & 1 > 0)
            x, y = x[ok], y[ok]
            ok = near(word[x], word[y])
            x, y = n[x[ok]], n[y[ok]]
            found.append((np.minimum(x, y), np.maximum(x, y)))
            held += len(x)
        if held and (held >= CANDIDATES or not len(at)):
            a, b = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.record_batch({"a": a[once], "b": b[once]})
            found, held = [], 0


def _paired(near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates of the places of a task, one place at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for place, high, data in zip(*(batch.column(c).to_pylist() for c in ("place", "high", "data")), strict=True):
                places.setdefault(place, []).append((high, data))
        while places:
            yield from _met(places.popitem()[1], near)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs of characters of a task's names fall into each cell."""
    sums = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for _, codes in _by_length(batch.column("key").to_pylist()):
            sums += np.bincount(_cell(_numbered(codes)).reshape(-1), minlength=CELLS)
    at = np.flatnonzero(sums)
    yield pa.record_batch({"cell": at.astype(np.int64), "often": sums[at]})


def pairs_of_names(leads: DataFrame, records: DataFrame) -> DataFrame:
    """(lead_key, record_key): all pairs of different names, of SIMILAR_LENGTH to LONGEST characters both, of similarity SIMILAR or more.

    leads and records: key. A name is looked at once, however many leads and records bear it. Keys are packed, some thousand
    in a row, and paired in arrays; kinds of keys, which never meet, go in rounds, each of which leaves only its candidates.
    """
    spark = leads.sparkSession
    sides = leads.select("key", F.lit(1).alias("side")).unionByName(records.select("key", F.lit(2).alias("side")))
    sides = sides.where(F.length("key").between(SIMILAR_LENGTH, LONGEST)).distinct().groupBy("key").agg(F.sum("side").cast("long").alias("side"))
    # the last two bits of a number say where the name stands
    names = swept(sides.select((F.monotonically_increasing_id() * 4 + F.col("side")).alias("n"), "key"), "names")
    often = np.ones(CELLS, dtype=np.uint64)
    long = names.where(F.length("key") > SIMILAR_LENGTH)
    for r in long.mapInArrow(_counted, "cell long, often long").groupBy("cell").agg(F.sum("often").alias("often")).collect():
        often[r.cell] = min(r.often, (1 << 31) - 1)
    lengths = {r.length: r.names for r in names.groupBy(F.length("key").alias("length")).agg(F.count(F.lit(1)).alias("names")).collect()}
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def candidates(kinds: set[str], entries: int) -> DataFrame:
        tasks = max(fewest, -(-entries // ENTRIES_A_TASK))
        # names are few bytes and make many keys: they are dealt anew
        packed = names.repartition(fewest).mapInArrow(_entries(kinds, often, min(tasks * PLACES_A_TASK, 1 << 16)), "place int, high long, data binary")
        return swept(packed.repartition(tasks, "place").mapInArrow(_paired(_near(kinds)), "a long, b long"), "candidates")

    found = spark.createDataFrame([], "a long, b long")
    for kinds, entries in _rounds(lengths):
        found = found.unionByName(candidates(kinds, entries))
    tasks = max(fewest, -(-found.count() // CANDIDATES_A_TASK))
    found = found.repartition(tasks, "a").distinct()
    for end in ("a", "b"):
        found = found.join(names.select(F.col("n").alias(end), F.col("key").alias(f"{end}_key")).hint("merge"), end)
    a, b = F.col("a_key"), F.col("b_key")
    edits = F.levenshtein(a, b) <= F.floor((1 - SIMILAR) * F.greatest(F.length(a), F.length(b)) + 1e-9)
    # what is near by edits, or too short, need not be counted for Dice
    found = found.withColumn("edits", edits).where(F.col("edits") | (dice_of_many(F.when(~F.col("edits") & (F.least(F.length(a), F.length(b)) > SIMILAR_LENGTH), a), b) >= SIMILAR - 1e-9))
    ways = F.array(*[F.struct(F.col(x).alias("l"), F.col(y).alias("r"), F.col(f"{x}_key").alias("lead_key"), F.col(f"{y}_key").alias("record_key")) for x, y in (("a", "b"), ("b", "a"))])
    stands = F.filter(ways, lambda w: (w["l"].bitwiseAND(1) > 0) & (w["r"].bitwiseAND(2) > 0))
    return swept(found.select(F.explode(stands).alias("w")).select("w.lead_key", "w.record_key"), "spellings")
