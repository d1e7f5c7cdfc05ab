"""Checksums of Australian business and company numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)


def digits(v: Column) -> Column:
    return F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), "[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0))


def is_abn(v: Column) -> Column:
    """Eleven digits whose weighted sum, the first digit less one, is a multiple of 89."""
    d = digits(v)
    total = sum((_digit(d, i + 1) - (1 if i == 0 else 0)) * w for i, w in enumerate(ABN_WEIGHTS))
    return (F.length(d) == 11) & (total % 89 == 0)


def is_acn(v: Column) -> Column:
    """Nine digits, the last of which completes the weighted sum of the others to a multiple of ten."""
    d = digits(v)
    total = sum(_digit(d, i + 1) * (8 - i) for i in range(8))
    return (F.length(d) == 9) & ((10 - total % 10) % 10 == _digit(d, 9))
