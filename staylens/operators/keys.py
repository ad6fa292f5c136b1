"""Key lookups: the value a key maps to when later rows overwrite earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins_lookup(dim: DataFrame, key: str, value: str, order_col: str | None = None) -> DataFrame:
    """key -> value, where for a repeated key the last row wins.

    "Last" is the highest `order_col` (default: the value itself, for ids
    given in insertion order). NULL keys are left out: they match nothing
    and would only pile up in one task. Columns: key, value.
    """
    base = dim.where(F.col(key).isNotNull())
    if order_col is None or order_col == value:
        agg = F.max(value).alias(value)
    else:
        agg = F.max_by(value, order_col).alias(value)
    return base.groupBy(key).agg(agg)


# A lookup at or below this many rows is broadcast (key + id: ~16 bytes a row).
BROADCAST_MAX_ROWS = 2_000_000


def day_span(df: DataFrame, date_col: str) -> int:
    """Upper bound on the distinct values of a date column: the days from its
    earliest to its latest value, inclusive (one min/max pass over the column;
    two values reach the driver)."""
    row = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).first()
    if row is None or row.lo is None:
        return 0
    return (row.hi - row.lo).days + 1


def bounded_broadcast(lookup: DataFrame, bound_rows: int | None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast `lookup` only when a proven bound on its rows is small
    enough; otherwise leave the join strategy to Spark (shuffle join, or AQE
    at run time)."""
    if bound_rows is not None and bound_rows <= max_rows:
        return F.broadcast(lookup)
    return lookup
