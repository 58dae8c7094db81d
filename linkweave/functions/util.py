from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name, a Column or a Python literal."""
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def lit_or_col(v) -> Column:
    """Parameters (limits, totals) may be plain numbers or Columns (e.g. scalar subqueries)."""
    return v if isinstance(v, Column) else F.lit(v)
