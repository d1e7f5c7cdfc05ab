"""MinHash near-dedup (5): min-max hashing.

Each permutation of the shingle hashes leaves two signature values, its minimum and its maximum, so that a signature of
2P values costs P evaluations. The values are cut into bands; texts that agree on a band are candidates.

1. Texts with the same set form a class; only one text of a class goes on.
2. In each band bucket the smallest member is compared with all others, on full sets, and components are formed.
3. In buckets that still hold several components, the members outside the largest one are compared with all members by
   their whole signatures, block by block; the pairs that may be similar enough are compared on full sets.

So every pair of a bucket is either connected or compared, and the pairs themselves are never written out. A pair of
similarity 0.75 shares a band with probability 1 - (1 - 0.75^5)^40 > 0.9999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import discard, materialize
from tracefold.llm.components import connected
from tracefold.llm.shingles import blocks, mix, rows_of, shingles, words

BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Links have 100 * intersection >= LINK * union.
LINK = 75
#: In step 3 members are compared by sketches, a byte for each signature value: first the values that the bands are made
#: of, then those of SKETCHED more permutations. Pairs that agree on a lesser share are not compared on full sets. By the
#: binomial law for 200 and 1,000 independent values, chance agreement of bytes included, a pair of similarity 0.75 falls
#: below the first bound with a probability of 0.0000009 and below the second with one of 0.0000002. Low halves of the band
#: keys tell which bucket of a pair is the first that it shares.
LEAST_AGREE, LEAST_AGREE_MORE = 0.60, 0.68
SKETCHED = 500
#: Members of a bucket that are compared at once in step 3.
CHUNK = 1500
#: A class of exact copies with more than this share of all rows gives its component by broadcast.
HOT = 1 / 2000

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _rng.integers(1, 2**62, 2, dtype=np.uint64)
MORE = _rng.integers(1, 2**62, SKETCHED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minmax(s: np.ndarray, factors: np.ndarray = FACTORS) -> np.ndarray:
    """The minima of all permutations of a set, then the maxima."""
    low, high = np.full(len(factors), 2**64 - 1, dtype=np.uint64), np.zeros(len(factors), dtype=np.uint64)
    for at in range(0, len(s), 4096):
        p = factors[:, None] * s[None, at : at + 4096]
        np.minimum(low, p.min(axis=1), out=low)
        np.maximum(high, p.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(3) + parts[:, :, k])
    return keys


def sketch(signature: np.ndarray) -> bytes:
    return (mix(signature) >> np.uint64(56)).astype(np.uint8).tobytes()


SIGNED = "doc long, n long, k1 long, k2 long, bands array<long>"
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary()), ("sketch", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in blocks(rows_of(batch, 2), 1):
            s = shingles(words([r[1] for r in group]))
            out = {"doc": [], "n": [], "k1": [], "k2": [], "bands": []}
            sets = [np.unique(s.hashes[a:b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
            full = [i for i, u in enumerate(sets) if len(u)]
            signatures = np.stack([minmax(sets[i]) for i in full]) if full else np.empty((0, 2 * PERMUTATIONS), dtype=np.uint64)
            keys = band_keys(signatures).view(np.int64)
            place = dict(zip(full, range(len(full)), strict=True))
            for i, ((doc, _), u) in enumerate(zip(group, sets, strict=True)):
                k = [int(x.astype(np.int64)) for x in (mix(u ^ SALTS[0]).sum(dtype=np.uint64), mix(u ^ SALTS[1]).sum(dtype=np.uint64))]
                out["doc"].append(doc)
                out["n"].append(len(u))
                out["k1"].append(k[0])
                out["k2"].append(k[1])
                out["bands"].append(keys[place[i]] if i in place else None)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in blocks(rows_of(batch, 2), 1):
            s = shingles(words([r[1] for r in group]))
            sets = [np.unique(s.hashes[a:b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
            signatures = [minmax(u) for u in sets]
            keys = band_keys(np.stack(signatures)).astype(np.uint32)
            sketches = [sketch(x) + sketch(minmax(u, MORE)) + k.tobytes() for x, u, k in zip(signatures, sets, keys, strict=True)]
            yield pa.RecordBatch.from_pydict({"node": [r[0] for r in group], "shingles": [u.tobytes() for u in sets], "sketch": sketches}, schema=SETS)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for *_, x, y in rows_of(batch, 4):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(bool(100 * both >= LINK * (len(a) + len(b) - both)))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, held against the full sets."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long")


def _close(g: pd.DataFrame) -> pd.DataFrame:
    """Of a block of members and a block of outsiders of one bucket: the pairs of different components whose sketches agree enough."""
    m, o = g[g.side == 0], g[g.side == 1]
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    if m.empty or o.empty:
        return none
    x = np.frombuffer(b"".join(m.sketch), dtype=np.uint8).reshape(len(m), -1)
    y = np.frombuffer(b"".join(o.sketch), dtype=np.uint8).reshape(len(o), -1)
    mn, on = m.n.to_numpy(), o.n.to_numpy()
    mc, oc, mr, outs = m.comp.to_numpy(), o.comp.to_numpy(), m.rep.to_numpy(), o.rep.to_numpy()
    first, band = 2 * PERMUTATIONS, int(g.band.iloc[0])
    last = first + 2 * SKETCHED
    bands, more, mk = (np.ascontiguousarray(x[:, a:b]) for a, b in ((0, first), (first, last), (last, None)))
    mk, ok = mk.view(np.uint32), np.ascontiguousarray(y[:, last:]).view(np.uint32)
    found = []
    for i in range(len(o)):
        at = np.flatnonzero((mc != oc[i]) & (100 * np.minimum(mn, on[i]) >= LINK * np.maximum(mn, on[i])))
        # a pair belongs to the first bucket that it shares, so that it is found once
        at = at[(mk[at] == ok[i]).argmax(axis=1) == band]
        at = at[np.count_nonzero(bands[at] == y[i, :first], axis=1) >= LEAST_AGREE * first]
        at = at[np.count_nonzero(more[at] == y[i, first:last], axis=1) >= LEAST_AGREE_MORE * 2 * SKETCHED]
        found += [(min(outs[i], mr[k]), max(outs[i], mr[k])) for k in at]
    return pd.DataFrame(sorted(set(found)), columns=["a", "b"]).astype("int64") if found else none


def _rest(members: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of step 3."""
    with_comp = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "band", "rep", F.coalesce("root", "rep").alias("comp"))
    sizes = with_comp.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where(F.col("all") > F.col("most"))
    # blocks of the members and of the outsiders of a bucket
    open_ = open_.select("key", "main", F.ceil(F.col("all") / CHUNK).cast("int").alias("mi"), F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int").alias("oi"))
    rows = with_comp.join(open_, "key").join(sketches, "rep")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    cols = ["key", "band", "i", "j", "side", "rep", "comp", "n", "sketch"]
    inner = rows.withColumns({"side": F.lit(0), "i": block("mi"), "j": F.explode(F.sequence(F.lit(0), F.col("oi") - 1))}).select(cols)
    outer = rows.where(F.col("comp") != F.col("main")).withColumns({"side": F.lit(1), "j": block("oi"), "i": F.explode(F.sequence(F.lit(0), F.col("mi") - 1))}).select(cols)
    return inner.unionByName(outer).groupBy("key", "i", "j").applyInPandas(_close, "a long, b long").distinct()


def _one_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that one id has rows in: they are one document."""
    key = F.struct("k1", "k2", "n")
    several = known.groupBy("doc").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high").select("doc")
    reps = known.join(several, "doc", "left_semi").join(classes, ["k1", "k2", "n"]).select("doc", "rep").distinct()
    return reps.join(reps.groupBy("doc").agg(F.min("rep").alias("a")), "doc").where("a != rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the columns n_shingles, component_id and kept.

    Words are runs outside ASCII white space, A-Z lower-cased; a set holds the distinct 5-word shingles, or the whole
    sequence of fewer words. Null and empty texts and texts without words have an empty set and are linked with nothing.
    component_id is the smallest id reachable over links, kept tells whether it is the row's own. Rows of one id are one
    document, linked with all that any of its texts is linked with (n_shingles is that of its largest set); rows without an
    id are linked with nothing, kept, and have null values. Ids are whole numbers. Other columns pass through, columns named
    like the new ones are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    columns = docs.columns
    # names that no column of the caller has
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = materialize(source.mapInArrow(_sign, SIGNED), "signed")
    known = signed.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = materialize(known.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")
    reps = materialize(
        known.join(classes.select(F.col("rep").alias("doc"), "k1", "k2"), ["doc", "k1", "k2"], "left_semi").dropDuplicates(["doc", "k1", "k2"]).select(F.col("doc").alias("rep"), "n", "bands"), "reps"
    )

    keyed = reps.select(F.posexplode("bands").alias("band", "key"), "rep")
    buckets = materialize(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub != last").drop("last"), "buckets")
    members = materialize(keyed.join(buckets, "key").select("key", "band", "hub", "rep"), "members")
    discard(buckets, reps)
    wanted = members.select(F.col("rep").alias("doc")).distinct()
    sets = materialize(source.join(wanted, "doc", "left_semi").dropDuplicates(["doc", "text"]).mapInArrow(_sets, "node long, shingles binary, sketch binary"), "sets")
    sketches = sets.select(F.col("node").alias("rep"), (F.length("shingles") / 8).cast("long").alias("n"), "sketch")

    by_hub = verified(members.where("hub != rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), sets)
    first = materialize(by_hub.unionByName(_one_id(known, classes)), "links")
    roots = connected(first)
    close = materialize(_rest(members, roots, sketches), "close")
    second = materialize(verified(close, sets), "links")
    discard(members, sets, close)
    if not second.isEmpty():
        roots = connected(first.unionByName(second))
    discard(first, second)

    keys = ["k1", "k2", "n"]
    rooted = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, "c", F.coalesce("root", "rep").alias("root"))
    # classes with more than a share of all rows go by broadcast: there are at most 1/HOT of them
    hot = F.col("c") > max(1000, int(signed.count() * HOT))
    own = signed.select("doc", *keys).where("n > 0").join(F.broadcast(rooted.where(hot).select(*keys, F.col("root").alias("hot_root"))), keys, "left")
    by_hot = own.where(F.col("hot_root").isNotNull()).select("doc", "n", F.col("hot_root").alias("root"))
    by_cold = own.where(F.col("hot_root").isNull()).drop("hot_root").join(rooted.where(~hot), keys, "left").select("doc", "n", "root")
    found = by_hot.unionByName(by_cold).unionByName(signed.where("n = 0").select("doc", "n", F.col("doc").alias("root")))
    found = found.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc")).alias("component_id"))
    # rows of one id: one document, in the smallest of their components
    by_id = found.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = docs.join(by_id.withColumnRenamed("doc", "id"), F.col(id_col).cast("long") == F.col("id"), "left").drop("id")
    return out.withColumn("kept", F.col(id_col).cast("long").eqNullSafe(F.col("component_id"))).toDF(*columns, "n_shingles", "component_id", "kept")


def near_dup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
