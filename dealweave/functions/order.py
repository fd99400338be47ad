"""Sort orders with the NULL placement the source data expects.

In the source system a descending sort puts NULLs first and an ascending one puts them last; Spark's defaults are the
other way round, so every sort in this package states its placement through these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def newest(c: str | Column) -> Column:
    """Descending, NULLs first (a plain DESC in the source system)."""
    return as_col(c).desc_nulls_first()


def newest_known(c: str | Column) -> Column:
    """Descending, NULLs last (DESC NULLS LAST)."""
    return as_col(c).desc_nulls_last()


def oldest(c: str | Column) -> Column:
    """Ascending, NULLs last (a plain ASC in the source system)."""
    return as_col(c).asc_nulls_last()
