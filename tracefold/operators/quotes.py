"""Texts that say a quote: all quotes at once, by an automaton over their beginnings, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quotes of a block, which each task is sent, and the characters of a quote that the automaton holds.
BLOCK, HEAD = 20_000, 40


def flat(text: Column) -> Column:
    """Lower-cased, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _find(sent):
    schema = pa.schema([("quote", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_head: dict[str, list[tuple[int, str]]] = {}
        for number, quote in sent.value:
            by_head.setdefault(quote[:HEAD], []).append((number, quote))
        automaton = ahocorasick.Automaton()
        for head in by_head:
            automaton.add_word(head, head)
        automaton.make_automaton()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text, found = text.as_py(), set()
                for end, head in automaton.iter(text or ""):
                    found.update(n for n, q in by_head[head] if n not in found and text.startswith(q, end + 1 - len(head)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), type=pa.int64()), pa.array([doc.as_py()] * len(found), type=pa.int64())], schema=schema)

    return run


def say(texts: DataFrame, quotes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(quote, doc): each text (doc, text) that holds a quote (quote, text), case and spacing aside.

    Ids are whole numbers; quotes and texts that are null or blank say nothing. Quotes go in blocks, a pass over the texts
    for each; nothing is joined.
    """
    q = quotes.select(F.col("quote").cast("long").alias("quote"), flat(F.col("text")).alias("text")).where("quote IS NOT NULL AND text <> ''")
    t = texts.select(F.col("doc").cast("long").alias("doc"), flat(F.col("text")).alias("text")).where("doc IS NOT NULL")
    spark, n = texts.sparkSession, q.count()
    blocks = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("quote", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = [(r.quote, r.text) for r in q.where(part == b).collect()]  # about BLOCK
        found = t.mapInArrow(_find(spark.sparkContext.broadcast(rows)), "quote long, doc long") if rows else spark.createDataFrame([], "quote long, doc long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
