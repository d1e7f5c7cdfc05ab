"""Folds over ordered logs without one task for each key: rows are range-partitioned by key and order, so that a key with many
rows lies in many tasks, one slice in each; a slice becomes one small row, and a key's slices are put together in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def slices(rows: DataFrame, key: str, order: list[str], seen: list[str], start: Callable[[], list], step: Callable[..., None], result: T.StructType) -> DataFrame:
    """(key, parts array<struct<part, *result>>): what each slice of a key's rows comes to, the slices in order.

    start gives the fields of `result` before any row; step(fields, *values of `seen`) changes them by one row.
    """
    part = T.StructField("part", T.IntegerType())
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), part, *result.fields])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current, fields = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *seen)), strict=True):
                if fields is None or k != current:
                    if fields is not None:
                        done.append((current, at, *fields))
                    current, fields = k, start()
                step(fields, *values)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), shape, strict=True)], schema=shape)
        if fields is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip((current, at, *fields), shape, strict=True)], schema=shape)

    held = rows.select(*dict.fromkeys([key, *order, *seen])).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    found = held.mapInArrow(run, schema)
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", *result.names))).alias("parts"))
