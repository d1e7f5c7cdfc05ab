"""Token-ID output (7): shard files of ids, each document compressed on its own with a dictionary that all share.

A file holds, all integers little-endian:

    magic "TFTOKEN1", sha256 of the dictionary (32 bytes), width of an id in bytes (1 byte: 2 or 4), 7 zero bytes
    one zstandard frame for each document, of its serialized ids
    index: n + 1 frame offsets (unsigned 64), n document ids (signed 64), n id counts (unsigned 64)
    index offset (unsigned 64), n (unsigned 64), magic "TFTOKEN1"

The dictionary lies beside the files, named by its hash. Documents are range-parted and sorted by doc_id, so the files in
order are the corpus in ascending doc_id order; a document can be read alone through the index of its file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import open_fs, scratch
from tracefold.llm.shingles import blocks, rows_of
from tracefold.llm.tokens import encoder, tokenizer_path

MAGIC = b"TFTOKEN1"
HEAD = 48
TAIL = 24
END_ID = 2
LEVEL = 3
#: What the index holds for a document without an id.
NO_ID = -(2**63)
#: The dictionary: its bytes, the documents that it is trained on at most, and the characters that it sees of one of them, at a
#: place drawn by the hash of its id.
DICTIONARY_BYTES = 65_536
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 8_192


def _write(path: str, parts) -> None:
    """All parts under another name first, so that a task that dies leaves no half file."""
    f, p = open_fs(path)
    temp = f"{p}.{uuid.uuid4().hex}.tmp"
    with f.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
    f.move(temp, p)


def train_dictionary(samples: list[bytes], end: bytes = b"\x02\x00", size: int = DICTIONARY_BYTES):
    """The shared zstandard dictionary of serialized id arrays.

    It is trained on the samples; where they are too few or too alike for the trainer, their own bytes are the dictionary.
    """
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # how the trainer says so
        return (b"".join(samples) or end * 4)[-size:].rjust(8, b"\0")


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def _compressor(dictionary: bytes):
    import zstandard

    d = _dictionary(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def _shard_writer(folder: str, tokenizer: str, end_id: int, width: int, dictionary):
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, head = encoder(tokenizer), _compressor(dictionary.value), hashlib.sha256(dictionary.value).digest()
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.tok"
        offsets, ids, counts = [HEAD], [], []

        def parts():
            yield MAGIC + head + bytes([width]) + bytes(7)
            for batch in batches:
                for group in blocks(rows_of(batch, 2), 1):
                    for (doc, _), got in zip(group, enc.encode([g[1] for g in group]), strict=True):
                        values = np.append(np.frombuffer(got, dtype="<u4"), end_id)
                        frame = packer.compress(values.astype(kind).tobytes())
                        offsets.append(offsets[-1] + len(frame))
                        ids.append(NO_ID if doc is None else doc)
                        counts.append(len(values))
                        yield frame
            yield np.array(offsets, dtype="<u8").tobytes() + np.array(ids, dtype="<i8").tobytes() + np.array(counts, dtype="<u8").tobytes()
            yield struct.pack("<QQ", offsets[-1], len(ids)) + MAGIC

        _write(path, parts())
        if ids:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "docs": len(ids), "tokens": sum(counts), "bytes": offsets[-1]}], schema=SHARDS)

    return run


class Shard:
    """A shard file, read through its index."""

    def __init__(self, path: str, dictionary: bytes):
        f, p = open_fs(path)
        self.file = f.open_input_file(p)
        size = self.file.size()
        at, n = struct.unpack("<QQ", self._read(size - TAIL, 16))
        if self._read(0, 8) != MAGIC or self._read(size - 8, 8) != MAGIC:
            raise ValueError(f"{path} is no token file")
        if self._read(8, 32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = {2: "<u2", 4: "<u4"}[self._read(40, 1)[0]]
        index = self._read(at, 8 * (3 * n + 1))
        self.offsets = np.frombuffer(index, dtype="<u8", count=n + 1)
        self.ids = np.frombuffer(index, dtype="<i8", count=n, offset=8 * (n + 1))
        self.counts = np.frombuffer(index, dtype="<u8", count=n, offset=8 * (2 * n + 1))
        self.unpacker = _decompressor(dictionary)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        frame = self._read(self.offsets[i], self.offsets[i + 1] - self.offsets[i])
        return np.frombuffer(self.unpacker.decompress(frame), dtype=self.kind).astype("<u4")

    def documents(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """The ids of documents of the file, in one read."""
        data = self._read(self.offsets[begin], self.offsets[end] - self.offsets[begin])
        cuts = (self.offsets[begin : end + 1] - self.offsets[begin]).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.frombuffer(self.unpacker.decompress(data[a:b]), dtype=self.kind).astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, by binary search in the index; None if the file does not hold it."""
        i = int(np.searchsorted(self.ids, doc_id))
        return self.document(i) if i < len(self.ids) and self.ids[i] == doc_id else None


def _dictionary_sample(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> list[bytes]:
    """Pieces of the documents with the smallest hashes, as serialized ids: the same for the same rows, in whatever order."""
    n = docs.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(10**15))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("doc_id", F.lit(3)), room.cast("long")) + 1).cast("int")
    some = docs.withColumn("draw", draw).where(F.col("draw") < int(10**15 * min(1.0, 1.2 * SAMPLE_DOCS / n)))
    some = some.select("draw", "doc_id", F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("draw", "doc_id", "text").limit(SAMPLE_DOCS)
    ids = encoder(tokenizer).encode([r.text for r in some.toLocalIterator()])
    return [np.append(np.frombuffer(x, dtype="<u4"), end_id).astype(kind).tobytes() for x in ids]


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the ids of all documents; the folder, and a row for each shard with `start`, the ids in the shards before it.

    Null and empty texts give the end id alone. Rows of one id stand beside each other, in the order of their texts. Rows
    without an id come first, as the id NO_ID. Other columns are not read; an empty table gives no file.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    folder = folder or scratch(spark, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 2**16 else 4
    kind = {2: "<u2", 4: "<u4"}[width]
    dictionary = train_dictionary(_dictionary_sample(docs, tokenizer, end_id, kind), np.array([end_id], dtype=kind).tobytes())
    f, p = open_fs(folder)
    f.create_dir(p, recursive=True)
    _write(f"{folder}/dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict", [dictionary])
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = _shard_writer(folder, tokenizer, end_id, width, spark.sparkContext.broadcast(dictionary))
    schema = "shard long, path string, docs long, tokens long, bytes long"
    rows, start = [], 0
    for r in sorted(map(tuple, parted.mapInArrow(writer, schema).collect())):  # a row for each file
        rows.append((*r, start))
        start += r[3]
    return folder, spark.createDataFrame(rows, schema + ", start long")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _shard_reader(dictionary, with_ids: bool):
    schema = READ.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else READ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path, dictionary.value)
                begins = start + np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))))
                for at in range(0, len(shard), 500):
                    rows = []
                    for i, ids in enumerate(shard.documents(at, min(at + 500, len(shard))), at):
                        row = {"doc_id": None if shard.ids[i] == NO_ID else int(shard.ids[i]), "start": int(begins[i]), "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                        rows.append(row | ({"ids": ids.tolist()} if with_ids else {}))
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_dictionary(folder: str) -> bytes:
    f, p = open_fs(folder)
    (path,) = [x.path for x in f.get_file_info(fs.FileSelector(p)) if x.path.endswith(".zdict")]
    with f.open_input_stream(path) as stream:
        return stream.read()


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""
    reader = _shard_reader(spark.sparkContext.broadcast(read_dictionary(folder)), with_ids)
    n = max(1, min(shards.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return shards.repartition(n).select("path", "start").mapInArrow(reader, schema)


def token_file_digest(docs: DataFrame) -> DataFrame:
    """Write the ids of every document to files, and read them back."""
    folder, shards = write_token_files(docs)
    return read_token_files(docs.sparkSession, folder, shards)
