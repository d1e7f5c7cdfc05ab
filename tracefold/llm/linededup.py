"""Line dedup (10): levelled sorted runs of line hashes.

A run is a table of line keys already seen, with the document that owns each, bucketed and sorted by hash. A new batch of
documents merge-joins the runs: keys found there belong to an earlier document; keys not found are new, and become a run of
their own. Two runs of one level are merged into one of the next, so a batch reads few runs and a key is rewritten only
once a level. Runs lie under a path of the caller's: `LineRuns.open` finds them again, and `add` takes further batches.

The runs keep their bucketing, so neither a look-up nor a merge shuffles a run again. Only DataFrame functions run; keys are
128-bit MD5 values of the normalised lines.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import discard, lower_ascii, materialize, open_fs, scratch

#: Characters that are stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Runs of one level that are merged.
FANOUT = 2
#: Characters of text in a batch, and the least number of batches that a corpus is cut into.
BATCH_CHARS, LEAST_BATCHES = 200_000_000_000, 4
#: A key that holds more than this share of a batch's lines is joined by broadcast; so there are at most 1/HOT of them.
HOT = 1 / 2000


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, h): the lines that can be shared. version tells the rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(text).alias("version"),
        F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("pos", "key"),
    )
    return lines.where(F.length("key") >= min_chars).select("doc", "version", "pos", F.unhex(F.md5("key")).alias("h"))


@dataclass
class LineRuns:
    """Runs under `path`, bucketed by `buckets`: levels[i] holds the folders of its runs, with no h in two of them.

    Batches are to come in the order in which documents take precedence: the first that holds a key owns it, within a batch
    the smallest id.
    """

    spark: SparkSession
    path: str
    buckets: int
    levels: list[list[str]] = field(default_factory=list)
    #: The tables of the runs in this session, by folder.
    names: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int | None = None) -> LineRuns:
        """The runs that `path` holds, or none yet. `buckets` is kept from the first batch on."""
        found, place = open_fs(f"{path}/runs.json")
        if found.get_file_info(place).is_file:
            with found.open_input_stream(place) as stream:
                saved = json.loads(stream.read())
            return LineRuns(spark, path, saved["buckets"], saved["levels"])
        return LineRuns(spark, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _save(self) -> None:
        found, place = open_fs(f"{self.path}/runs.json")
        with found.open_output_stream(place) as out:
            out.write(json.dumps({"buckets": self.buckets, "levels": self.levels}).encode())

    def _write(self, keys: DataFrame, folder: str) -> None:
        """(h, owner) as a run."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.select("h", "owner").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.names[folder] = name

    def _read(self, folder: str) -> DataFrame:
        if folder not in self.names:
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BINARY, owner BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
            self.names[folder] = name
        return self.spark.table(self.names[folder])

    def _drop(self, folder: str) -> None:
        if folder in self.names:
            self.spark.sql(f"DROP TABLE {self.names.pop(folder)}")  # the files of a table with a path stay
        found, place = open_fs(f"{self.path}/{folder}")
        found.delete_dir(place)

    def tables(self) -> list[DataFrame]:
        return [self._read(f) for level in self.levels for f in level]

    def push(self, keys: DataFrame) -> None:
        """Take (h, owner) of new keys as a run, merging each level that is full."""
        folder, level = f"run-{uuid.uuid4().hex}", 0
        self._write(keys, folder)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(folder)
            if len(self.levels[level]) < FANOUT:
                break
            a, b = (self._read(f) for f in self.levels[level])
            # no key is in both, so this outer join by merge is the merge of two sorted runs
            merged = a.join(b.withColumnRenamed("owner", "other"), "h", "full_outer").select("h", F.coalesce("owner", "other").alias("owner"))
            folder = f"run-{uuid.uuid4().hex}"
            self._write(merged, folder)
            old, self.levels[level] = self.levels[level], []
            level += 1
            for f in old:
                self._drop(f)
        self._save()

    def lost(self, lines: DataFrame) -> DataFrame:
        """(doc, version, positions): the lines that each document of a batch loses; the batch's own new keys become a run."""
        state = lines.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
        firsts = []
        for i, run in enumerate(self.tables()):
            firsts.append(f"first{i}")
            state = state.join(run.withColumnRenamed("owner", firsts[-1]).hint("merge"), "h", "left")
        first = F.coalesce(*firsts) if len(firsts) > 1 else F.col(firsts[0]) if firsts else F.lit(None).cast("long")
        state = materialize(state.select("h", F.coalesce(first, "owner").alias("owner"), "last", "n", first.isNotNull().alias("old")), "line-state")
        shared = state.where(F.col("owner") != F.col("last")).select("h", "owner", "n")
        gone = materialize(lost_in(lines, shared), "lost")
        self.push(state.where(~F.col("old")))
        discard(state)
        return gone

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
        """A batch of documents: `docs` without the lines that the runs or a smaller id of the batch hold, as `dedup_lines` gives them."""
        lines = materialize(lines_of(docs, id_col, text_col, min_chars), "lines")
        gone = self.lost(lines)
        discard(lines)
        return without(docs, gone, id_col, text_col)

    def remove(self) -> None:
        """Forget all runs."""
        for level in self.levels:
            for folder in level:
                self._drop(folder)
        self.levels = []


def lost_in(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """The lines of a batch whose key another document owns, as arrays of positions."""
    total = shared.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(1000, int(total * HOT))
    hot, cold = shared.where(is_hot).select("h", F.col("owner").alias("hot_owner")), shared.where(~is_hot).select("h", "owner")
    joined = lines.join(F.broadcast(hot), "h", "left")
    by_hot = joined.where(F.col("hot_owner").isNotNull()).select("doc", "version", "pos", F.col("hot_owner").alias("owner"))
    by_cold = joined.where(F.col("hot_owner").isNull()).select("doc", "version", "pos", "h").join(cold, "h").select("doc", "version", "pos", "owner")
    gone = by_hot.unionByName(by_cold).where(F.col("doc") != F.col("owner"))
    return gone.groupBy("doc", "version").agg(F.collect_list("pos").alias("positions"))


def batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Upper bounds of all batches but the last: ids that part the table into about equal ranges.

    Bounds only balance the work; any bounds give the same result.
    """
    if batches < 2:
        return []
    qs = docs.select(F.col(id_col).cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.02)
    return sorted({int(q) for q in qs})


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int | None) -> DataFrame:
    """(doc, version, positions) over a whole table, whose ids go through runs of their own in ascending batches."""
    spark = docs.sparkSession
    if batches is None:
        chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
        batches = max(LEAST_BATCHES, math.ceil(chars / BATCH_CHARS))
    bounds = batch_bounds(docs, id_col, batches)
    batch = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        batch = F.when(F.col("doc") <= b, F.lit(i)).otherwise(batch)
    lines = materialize(lines_of(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines", partition_by="batch")
    runs = LineRuns.open(spark, scratch(spark, "line-runs"))
    lost = [runs.lost(lines.where(F.col("batch") == i).drop("batch")) for i in range(len(bounds) + 1)]
    discard(lines)
    runs.remove()
    out = lost[0]
    for x in lost[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc", "version").agg(F.flatten(F.collect_list("positions")).alias("positions"))


def without(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text, from the positions that its rows lose."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    # own names for what is added, so that no column of the caller's is hit
    own = docs.select(*columns).toDF(*[f"c{i}" for i in range(len(columns))])
    doc, value = f"c{columns.index(id_col)}", F.coalesce(F.col(f"c{columns.index(text_col)}"), F.lit(""))
    joined = own.withColumn("own_version", F.xxhash64(value)).join(
        lost.hint("shuffle_hash"), (F.col(doc).cast("long") == F.col("doc")) & (F.col("own_version") == F.col("version")), "left"
    )
    lines = F.split(value, "\n", -1)
    joined = joined.withColumn("lines", lines).withColumn("n", F.size("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.coalesce("positions", F.array().cast("array<int>")))
    joined = joined.withColumn("kept", F.when(F.col("positions").isNotNull(), kept))
    none = F.col("positions").isNull()
    return joined.select(
        *own.columns,
        F.col("n").cast("long"),
        F.when(none, F.lit(0)).otherwise(F.col("n") - F.size("kept")).cast("long"),
        F.when(none, value).otherwise(F.array_join(F.transform("kept", lambda i: F.element_at("lines", i + 1)), "\n")),
    ).toDF(*columns, "n_lines", "n_dropped", "kept_text")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int | None = None) -> DataFrame:
    """`docs` with the columns n_lines, n_dropped and kept_text.

    Keys of at least `min_chars` code points that at least two documents hold lose all lines but those in the document of
    the smallest id. Null and empty texts: one empty line, never dropped. Rows of one id are one document: each keeps the
    lines that the id owns. Rows without an id own no line and lose none; ids are whole numbers. Other columns pass
    through, whatever their names, columns named like the new ones are replaced; an empty table gives an empty table.
    `batches`: how many ranges of ids, by default one for every BATCH_CHARS characters, LEAST_BATCHES at least.
    """
    return without(docs, dropped_lines(docs, id_col, text_col, min_chars, batches), id_col, text_col)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
