"""Language ID (8): a bidirectional gated recurrent network over bytes labels every position of a text; a document has the
language of the largest mean probability over all of its positions.

A text is read in windows of WINDOW bytes, all of them, whatever its length; the states start anew in each window. The
network is trained on the driver from a bounded sample: at most about SAMPLE documents of known language, WINDOWS windows of
TRAIN_BYTES bytes each, whose crc32 of the id modulo 5 is not 0; the others are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm import gru
from tracefold.llm.shingles import blocks, rows_of

HIDDEN = 8
WINDOW = 128
#: Windows that are labelled at once.
ROWS = 2048
SAMPLE = 3000
#: Documents of each language that are learned from at least, where there are so many.
PER_LANGUAGE = 200
WINDOWS = 2
TRAIN_BYTES = 64
STEPS = 260
UNKNOWN = "und"
#: Documents whose best mean probability lies below are rejected by the filter.
LEAST_SCORE = 0.4


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose crc32, as text, is a multiple of 5. A null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], gru.Params] | None:
    """The learned languages and the network; None where there is nothing to learn from."""
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    n = sum(counts.values())
    # the share of a language that is drawn; by id and text, as an id may stand for many rows
    shares = {lang: min(1.0, max(SAMPLE / n, PER_LANGUAGE / k)) for lang, k in counts.items()}
    least = F.create_map(*[F.lit(x) for lang, share in sorted(shares.items()) for x in (lang, int(10**15 * share))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.lit(17)), F.lit(10**15))
    some = known.where(draw < F.element_at(least, F.col(lang_col)))
    room = F.greatest(F.length(text_col) - TRAIN_BYTES, F.lit(0)) + 1
    at = lambda k: (F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(k)), room.cast("long")) + 1).cast("int")
    parts = [F.substring(F.col(text_col), at(k), F.lit(TRAIN_BYTES)).alias(f"w{k}") for k in range(WINDOWS)]
    rows = sorted(tuple(r) for r in some.select(F.col(id_col).cast("long"), F.col(lang_col), *parts).collect())
    if not rows:
        return None
    langs = sorted({r[1] for r in rows})
    x, y = [], []
    for _, lang, *windows in rows:
        for w in windows:
            raw = w.encode("utf-8", "replace")
            # a shorter text is repeated: every position of a training window has a byte
            x.append(np.resize(np.frombuffer(raw + b" ", dtype=np.uint8), TRAIN_BYTES) if len(raw) < TRAIN_BYTES else np.frombuffer(raw[:TRAIN_BYTES], dtype=np.uint8))
            y.append(langs.index(lang))
    return langs, gru.train(np.stack(x), np.array(y), len(langs), HIDDEN, STEPS)


def mean_probabilities(net: gru.Labeller, texts: list[str]) -> np.ndarray:
    """(texts, labels): the label probabilities of each text, averaged over all of its bytes. Texts must not be empty."""
    raw = [np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8) for t in texts]
    sizes = np.array([len(r) for r in raw])
    total = np.zeros((len(texts), net.labels))
    full = [(r[: len(r) // WINDOW * WINDOW].reshape(-1, WINDOW), i) for i, r in enumerate(raw) if len(r) >= WINDOW]
    if full:
        windows, owners = np.concatenate([w for w, _ in full]), np.concatenate([np.full(len(w), i) for w, i in full])
        for at in range(0, len(windows), ROWS):
            sums = net.sums(np.ascontiguousarray(windows[at : at + ROWS].T))
            np.add.at(total, owners[at : at + ROWS], sums.T)
    rest = [(i, r[len(r) // WINDOW * WINDOW :]) for i, r in enumerate(raw) if len(r) % WINDOW]
    rest.sort(key=lambda x: len(x[1]))
    for at in range(0, len(rest), ROWS):
        part = rest[at : at + ROWS]
        widest = max(len(r) for _, r in part)
        x = np.zeros((widest, len(part)), dtype=np.uint8)
        for k, (_, r) in enumerate(part):
            x[: len(r), k] = r
        sums = net.sums(x, np.array([len(r) for _, r in part]))
        np.add.at(total, [i for i, _ in part], sums.T)
    return total / sizes[:, None]


def _predict(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, params = model.value if model.value else ([], None)
        net = gru.Labeller(params) if params else None
        for batch in batches:
            lang, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            texts = enumerate(t for (t,) in rows_of(batch.select([text_at]), 1))
            known = ((i, t) for i, t in texts if net and t and any(map(str.isalpha, t)))
            for group in blocks(known, 1):
                p = mean_probabilities(net, [t for _, t in group])
                for (i, _), row in zip(group, p, strict=True):
                    best = int(row.argmax())
                    lang[i], score[i] = langs[best], float(min(1.0, row[best]))
            yield batch.append_column("lang_pred", pa.array(lang)).append_column("score", pa.array(score))

    return run


def identify(docs: DataFrame, model: tuple[list[str], gru.Params] | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, the mean probability of that language.

    A null text or one without a letter is `und` with score 0, and so is every text where nothing was learned. Each row
    stands for itself, whatever its id; other columns pass through, columns named like the new ones are replaced; an empty
    table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(model, docs.columns.index(text_col)), schema)


def keep_identified(docs: DataFrame, model: tuple[list[str], gru.Params] | None, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` whose language is known with a score of `least`, with their own columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    kept = identify(plain, model, f"c{columns.index(text_col)}").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").toDF(*columns)


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
