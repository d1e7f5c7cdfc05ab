"""Quality classifier (11): supervised subword embeddings.

The features of a text are its words (runs of non-blanks, A-Z lower-cased), the runs of 3, 4 and 5 bytes of `GRAMS` that hold
no blank but at their ends, as written, and one for its end. Features are hashed into BUCKETS rows of a table of vectors; a
text is the mean of its features' vectors, and a softmax over that mean gives the probability of each label. Vectors and
output are learned together by stochastic gradient descent in numpy, a text at a step.

The network is learned on the driver from a bounded sample: about SAMPLE labelled documents, at least PER_LABEL of each label
where there are so many, weighted back to the shares of the labels; from each, the counts of its buckets over the whole text.
On documents only the difference of the two logits matters, and it is linear in the mean: each bucket has one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.langid import held_out
from tracefold.llm.pieces import in_groups
from tracefold.llm.shingles import IS_BLANK, rows_of, words

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
DIMENSIONS = 8
SAMPLE, PER_LABEL = 2000, 500
EPOCHS, RATE = 6, 0.3
LEAST_SCORE = 0.3

_CODE = (np.random.default_rng(31).integers(1, 2**32, 256, dtype=np.uint64)).astype(np.uint32)
_CODE[IS_BLANK] = _CODE[32]
_FACTOR = np.uint32(0x9E3779B1)


def features(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first) for each kind of feature: those of piece i are buckets[first[i]:first[i + 1]]."""
    w = words([p.decode("utf-8", "replace") for p in parts])
    yield (w.hashes >> np.uint64(48)).astype(np.int64), w.first
    buf = np.frombuffer(b"".join(b" " + p + b" " for p in parts), dtype=np.uint8)
    starts = np.cumsum([0] + [len(p) + 2 for p in parts])
    blank, code = IS_BLANK[buf], _CODE[buf]
    acc, inner = code, np.zeros(len(buf), dtype=bool)
    for n in range(2, max(GRAMS) + 1):
        m = len(buf) - n + 1
        acc = acc[:m] * _FACTOR + code[n - 1 :]
        inner = inner[:m] | (blank[n - 2 : n - 2 + m] if n > 2 else False)
        if n in GRAMS:
            at = np.flatnonzero(~inner)
            h = acc[at] ^ (acc[at] >> np.uint32(15))
            yield ((h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(16)).astype(np.int64), np.searchsorted(at, starts)


def bucket_counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each whole text; the end of the text is the bucket BUCKETS."""
    total = [{} for _ in texts]
    for owners, parts in in_groups(enumerate(texts)):
        for buckets, first in features(parts):
            for k, i in enumerate(owners):
                found, n = np.unique(buckets[first[k] : first[k + 1]], return_counts=True)
                for b, c in zip(found.tolist(), n.tolist(), strict=True):
                    total[i][b] = total[i].get(b, 0) + c
    for t in total:
        t[BUCKETS] = 1
    return [(np.array(sorted(t), dtype=np.uint32), np.array([t[b] for b in sorted(t)], dtype=np.uint32)) for t in total]


class Network(dict):
    """E (vectors), W (labels x dimensions) and b (labels)."""


def fresh(seed: int = 5) -> Network:
    r = np.random.default_rng(seed)
    return Network(E=r.uniform(-1, 1, (BUCKETS + 1, DIMENSIONS)).astype(np.float64) / DIMENSIONS, W=r.normal(0, 0.1, (2, DIMENSIONS)), b=np.zeros(2))


def gradients(net: Network, buckets: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The loss of one text, and its gradients by W, by b and by the mean vector."""
    mean = share @ net["E"][buckets]
    z = net["W"] @ mean + net["b"]
    p = np.exp(z - z.max())
    p /= p.sum()
    d = p.copy()
    d[label] -= 1
    return -float(np.log(max(p[label], 1e-12))), np.outer(d, mean), d, net["W"].T @ d


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weights: list[float], epochs: int = EPOCHS, rate: float = RATE) -> Network:
    """Stochastic gradient descent, a text at a step.

    A mean of thousands of vectors hardly moves with each of them, so the step of the vectors is divided by the sum of the
    squared shares: the mean of a text moves alike at every length.
    """
    net, r = fresh(), np.random.default_rng(6)
    shares = [c / c.sum() for _, c in texts]
    paces = [1 / float(s @ s) for s in shares]
    steps = epochs * len(texts)
    for epoch in range(epochs):
        for k, i in enumerate(r.permutation(len(texts))):
            step = rate * weights[i] * (1 - (epoch * len(texts) + k) / steps)
            buckets = texts[i][0]
            _, dw, db, dm = gradients(net, buckets, shares[i], labels[i])
            net["W"] -= step * dw
            net["b"] -= step * db
            net["E"][buckets] -= (step * paces[i] * shares[i])[:, None] * dm[None, :]
    return net


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, label, text in rows_of(batch, 3):
            (buckets, counts) = bucket_counts([text])[0]
            yield pa.RecordBatch.from_pydict(
                {"doc": [doc], "label": [label], "buckets": [buckets.tobytes()], "counts": [counts.tobytes()]},
                schema=pa.schema([("doc", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())]),
            )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, per_label: int = PER_LABEL) -> Network | None:
    """The network, from labelled documents that are not held out; None where there is nothing to learn from.

    Labels other than 0 and 1 are none. An id with both labels counts as 0; an id with several texts is learned from one of
    them. The sample is drawn by the hash of the id, each label by its own share.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
    given = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    given = given.groupBy("doc").agg(F.min("label").alias("label")).join(ids, "doc", "left_semi").where(~held_out("doc"))
    counts = {r[0]: r[1] for r in given.groupBy("label").count().collect()}
    if not counts:
        return None
    n = sum(counts.values())
    shares = {k: min(1.0, max(sample / n, per_label / c)) for k, c in counts.items()}
    least = F.create_map(*[F.lit(x) for k, share in sorted(shares.items()) for x in (k, int(10**15 * share))])
    drawn = given.where(F.pmod(F.xxhash64("doc", F.lit(23)), F.lit(10**15)) < F.element_at(least, F.col("label")))
    # about SAMPLE + PER_LABEL rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "doc")
    texts = texts.groupBy("doc", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(texts.select("doc", "label", "text").mapInArrow(_count, "doc long, label int, buckets binary, counts binary").collect())
    if not rows:
        return None
    data = [(np.frombuffer(r.buckets, dtype=np.uint32).astype(np.int64), np.frombuffer(r.counts, dtype=np.uint32).astype(np.float64)) for r in rows]
    weight = {k: max(shares.values()) / share for k, share in shares.items()}
    mean = sum(weight[r.label] for r in rows) / len(rows)
    return train(data, [r.label for r in rows], [weight[r.label] / mean for r in rows])


def _score(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, bias = model.value
        for batch in batches:
            total, size = np.full(batch.num_rows, worth[BUCKETS]), np.ones(batch.num_rows)
            texts = enumerate(t for (t,) in rows_of(batch.select([text_at]), 1))
            for owners, parts in in_groups(texts):
                for buckets, first in features(parts):
                    sums = np.concatenate(([0.0], np.cumsum(worth[buckets])))
                    np.add.at(total, owners, sums[first[1:]] - sums[first[:-1]])
                    np.add.at(size, owners, np.diff(first))
            p = 1 / (1 + np.exp(-np.clip(total / size + bias, -500, 500)))
            yield batch.append_column("score", pa.array(p)).append_column("predicted", pa.array((p >= LEAST_SCORE).astype(np.int32)))

    return run


def score(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """`docs` with score, the probability of label 1, and predicted, 1 from a score of LEAST_SCORE.

    A null text is an empty one, and an empty one is scored by its end alone; where nothing was learned every score is 0.5. Each row
    stands for itself, whatever its id; other columns pass through, columns named like the new ones are replaced; an empty
    table gives an empty table.
    """
    docs = docs.drop("score", "predicted")
    worth = net["E"] @ (net["W"][1] - net["W"][0]) if net else np.zeros(BUCKETS + 1)
    model = docs.sparkSession.sparkContext.broadcast((worth, float(net["b"][1] - net["b"][0]) if net else 0.0))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(model, docs.columns.index(text_col)), schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
