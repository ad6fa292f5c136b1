"""Profiles of a table: missing values, distinct values, date ranges.

Each profile is one aggregation pass over the table (many columns at once),
never one job per column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.numeric import pct_of
from staylens.schemas import ROW_POS


def _q(name: str):
    return F.col(f"`{name}`")


def _data_columns(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    return list(columns) if columns is not None else [c for c in df.columns if c != ROW_POS]


def is_missing(df: DataFrame, name: str):
    """NULL, or NaN in a column of floating numbers."""
    col = _q(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_report(df: DataFrame, columns: Iterable[str] | None = None,
                   group_cols: Iterable[str] = ()) -> DataFrame:
    """Per column: missing count and percent of rows (NaN counts as missing).

    Columns: *group_cols, column_name, position (0-based column order),
    missing_count, missing_pct. One pass: all counts in a single (grouped)
    aggregate, then unpivoted.
    """
    groups = list(group_cols)
    cols = [c for c in _data_columns(df, columns) if c not in groups]
    counts = df.groupBy(*[_q(g) for g in groups]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                                 F.col(f"_m{i}").alias("missing_count")) for i, c in enumerate(cols)])
    return (counts.select(*[_q(g) for g in groups], "_n", F.inline(entries))
            .select(*[_q(g) for g in groups], "column_name", "position", "missing_count",
                    pct_of("missing_count", "_n").alias("missing_pct")))


def unique_values(df: DataFrame, columns: Iterable[str], order_col: str = ROW_POS) -> DataFrame:
    """Distinct values of several columns, NULL included, with the position of
    their first appearance (sort by it for first-appearance order).

    Columns: column_name, value (as text), first_pos. The columns are unpivoted
    and grouped together, so it is one shuffle for all of them; partial
    aggregation collapses frequent values before the shuffle.
    """
    cols = list(columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("value"))
                      for c in cols])
    return (df.select(F.col(order_col).alias("_pos"), F.inline(pairs))
            .groupBy("column_name", "value").agg(F.min("_pos").alias("first_pos")))


def date_range(df: DataFrame, columns: Iterable[str], group_cols: Iterable[str] = ()) -> DataFrame:
    """Earliest and latest value of each column (NULLs skipped), one pass.

    Columns: *group_cols, column_name, earliest, latest.
    """
    cols = list(columns)
    groups = [_q(g) for g in group_cols]
    bounds = df.groupBy(*groups).agg(
        *[F.struct(F.min(_q(c)).alias("earliest"), F.max(_q(c)).alias("latest")).alias(f"_b{i}")
          for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_b{i}.earliest").alias("earliest"),
                                 F.col(f"_b{i}.latest").alias("latest")) for i, c in enumerate(cols)])
    return bounds.select(*groups, F.inline(entries))


def drop_incomplete(df: DataFrame, columns: Iterable[str], how: str = "any") -> DataFrame:
    """Rows with a value in every one of the columns (`how="any"` missing drops
    a row), or in at least one (`"all"`). NaN counts as missing."""
    if how not in ("any", "all"):
        raise ValueError(f"how must be 'any' or 'all', not {how!r}")
    missing = [is_missing(df, c) for c in columns]
    drop = F.lit(how == "all" and bool(missing))
    for m in missing:
        drop = drop | m if how == "any" else drop & m
    return df.where(~drop)


def incomplete_report(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Why rows go: reason (the first of the columns, in their order, that is
    missing; `complete` for rows that stay), n_rows, n_missing (cells missing
    in these rows). One pass; reasons without rows are left out."""
    cols = list(columns)
    reason, cells = F.lit("complete"), F.lit(0)
    for c in reversed(cols):
        reason = F.when(is_missing(df, c), F.lit(c)).otherwise(reason)
        cells = cells + is_missing(df, c).cast("int")
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(cells).cast("bigint").alias("n_missing"))
