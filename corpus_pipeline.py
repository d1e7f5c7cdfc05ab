"""From raw documents to packed sequences: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of `documents`. Between two
stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontaminate, langid, linededup, neardup, packing
from tracefold.llm.common import discard, materialize
from tracefold.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter, or whose language is unsure, go."""
    return langid.keep_identified(docs, langid.learn(docs))


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with columns of names that no operator uses, and the names of its id and text there."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds; null texts stay null, n_chars follows the text."""
    plain, id_col, text_col = _plain(docs)
    text = F.when(F.col(text_col).isNotNull(), F.col("kept_text"))
    changed = {text_col: text}
    if "n_chars" in docs.columns:
        changed[f"c{docs.columns.index('n_chars')}"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return linededup.dedup_lines(plain, id_col, text_col).withColumns(changed).select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    plain, id_col, text_col = _plain(docs)
    return neardup.near_duplicates(plain, id_col, text_col).where("kept").select(*plain.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents, each with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the trained and the linking stages; tests hold run() against a brute-force version.
ORACLE_SQL = None
