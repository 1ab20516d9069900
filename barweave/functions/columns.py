"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.least(c, lit(high)), lit(low))


def rounded(c: Column | str, digits: int) -> Column:
    """Rounds half up; noise below 9 digits doesn't decide a tie."""
    return F.round(F.round(c, 9), digits)
