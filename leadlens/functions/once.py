"""A value that several parts of an expression use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row; written out, each use in a lambda would work it out again."""
    return F.transform(F.array(value), use)[0]
