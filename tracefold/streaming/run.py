"""Running a stream to its end and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracefold.shared import fresh_path


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there, batch by batch, as a table. A batch that runs twice overwrites its own part."""
    base = fresh_path(stream.sparkSession, "stream")
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")
