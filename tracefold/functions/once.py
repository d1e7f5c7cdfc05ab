"""Steps of an expression that several places speak of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once however often f speaks of it: an expression would be repeated at each place."""
    return F.element_at(F.transform(F.array(value), f), 1)
