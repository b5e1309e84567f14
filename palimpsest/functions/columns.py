"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row.

    The optimizer may copy a projected column's expression to where it is used, and inside a lambda that
    means once an element. A lambda's variable is never expanded.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
