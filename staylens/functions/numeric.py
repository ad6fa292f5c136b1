"""Numeric functions: rounding and percentage change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """Round a double the way an array library does: scale, round to the
    nearest even integer, scale back. 2.345 -> 2.35, 0.125 -> 0.12,
    2.675 -> 2.68 (`round` gives 0.13, `bround` 2.34)."""
    scale = float(10 ** digits)
    return F.rint(_col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def pct_change(new: Column | str, base: Column | str) -> Column:
    """((new - base) / base) * 100 in doubles; NULL when base is 0."""
    n, b = _col(new).cast("double"), _col(base).cast("double")
    return F.try_divide(n - b, b) * F.lit(100.0)


def pct_of(part: Column | str, whole: Column | str) -> Column:
    """part / whole * 100 in doubles; NULL when whole is 0."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double")) * F.lit(100.0)
