"""Rows dealt over tasks by their number. Spark puts small partitions together by their compressed bytes; ids that run on
compress to a few bytes each, so that one task may come to hold many millions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: About as many rows as a task that must hold its rows (to sort or to group them) should hold.
ROWS_A_TASK = 500_000
#: Up to so many times that, Spark deals as it will.
FEW = 4


def tasks_for(rows: DataFrame) -> int:
    """Over how many tasks to deal rows; 0: they are few. Counts them, which for columns of a table is read from its files' footers."""
    need = -(-rows.count() // ROWS_A_TASK)
    return max(need, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if need > FEW else 0


def dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """`rows` with equal keys in one of so many tasks; as they are if 0."""
    return rows.repartition(tasks, *keys) if tasks else rows
