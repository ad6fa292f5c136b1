"""Mergeable distinct counts: HyperLogLog sketches per month and group,
stored once; the distinct count of any range of months is a union of them,
without a second pass over the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.dates import month_end

#: Base-2 logarithm of a sketch's registers; relative error about 1.04 / sqrt(2 ** LOG_K).
LOG_K = 16


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def distinct_sketches(df: DataFrame, entity: str, date_col: str, group_cols: Iterable[str] = (), log_k: int = LOG_K) -> DataFrame:
    """Per month end (and group): sketch of the distinct `entity` values. Rows
    without a date, a group key or an entity go."""
    groups = list(group_cols)
    for c in (entity, date_col, *groups):
        df = df.where(_q(c).isNotNull())
    value = _q(entity) if dict(df.dtypes)[entity] in ("int", "bigint", "string", "binary") else _q(entity).cast("string")
    return (df.groupBy(month_end(_q(date_col)).alias("month_end"), *(_q(g) for g in groups))
            .agg(F.hll_sketch_agg(value, log_k).alias("sketch")))


def distinct_in(sketches: DataFrame, by: Iterable[Column | str] = (), first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Estimated distinct entities per `by` (columns of the sketches, or
    expressions such as a year), over the months from `first` to `last`."""
    if first is not None:
        sketches = sketches.where(F.col("month_end") >= first)
    if last is not None:
        sketches = sketches.where(F.col("month_end") <= last)
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("n_estimated", F.hll_sketch_estimate("sketch")).drop("sketch")
