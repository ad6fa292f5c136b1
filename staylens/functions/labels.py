"""Label text of report values (the numbers shown on cards and charts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def thousands(c: Column | str) -> Column:
    """1500 -> '1,500'."""
    return F.format_number(_col(c), 0)


def money(c: Column | str) -> Column:
    """25539.316 -> '$25,539.32'."""
    return F.concat(F.lit("$"), F.format_number(_col(c).cast("double"), 2))


def fixed(c: Column | str, digits: int, suffix: str = "") -> Column:
    """Fixed-point text: fixed(15.6086, 1, ' days') -> '15.6 days'.

    The exact binary value is rounded, half to even, so 0.35 (a little less)
    gives 0.3 and 15.65 (a little more) gives 15.7; a negative zero keeps its sign.
    """
    text = F.replace(F.format_number(_col(c).cast("double"), digits), F.lit(","), F.lit(""))
    return F.concat(text, F.lit(suffix)) if suffix else text


def signed_pct(c: Column | str, digits: int = 1) -> Column:
    """3.25 -> '+3.2%'."""
    text = fixed(c, digits, "%")
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def count_label(c: Column | str, noun: str = "patients") -> Column:
    """261 -> '261 patients'."""
    return F.concat(_col(c).cast("string"), F.lit(f" {noun}"))


def rate_label(c: Column | str) -> Column:
    """0.007 -> '0.7%/yr'."""
    return fixed(_col(c).cast("double") * F.lit(100.0), 1, "%/yr")
