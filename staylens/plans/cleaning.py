"""Cleaning run: raw encounters -> clean table + run report.

Order matters and follows the source run: profile the raw table, drop
duplicate rows (keep first), title-case names, parse the two dates, list
category values, drop billing outliers (statistics taken after the dedup),
report date ranges, save.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.dates import KNOWN_FORMATS, format_number, parse_date, parse_date_as, parse_timestamp
from staylens.functions.text import title_case
from staylens.functions.numeric import pct_of
from staylens.operators.dedup import COPIES, drop_duplicates, group_first, with_row_hash
from staylens.operators import outliers
from staylens.operators.outliers import remove_outliers
from staylens.operators.profile import is_missing, unique_values
from staylens.schemas import (ADMIT_DATE, BILLING, CATEGORY_COLUMNS, DATE_FORMAT, DISCHARGE_DATE, NAME,
                              OUTLIER_THRESHOLD, ROW_POS, TIMESTAMP_FORMAT)


@dataclass
class CleaningStages:
    raw: DataFrame
    dedup: DataFrame
    titled: DataFrame
    dated: DataFrame
    clean: DataFrame
    copies: DataFrame | None = None  # the deduplicated rows, each with the number of raw rows equal to it


def format_names(df: DataFrame, column: str = NAME) -> DataFrame:
    return df.withColumn(column, title_case(F.col(f"`{column}`")))


def format_dates(df: DataFrame, columns: Iterable[str] = (ADMIT_DATE, DISCHARGE_DATE),
                 fmt: str | tuple[str, ...] = DATE_FORMAT) -> DataFrame:
    return df.withColumns({c: parse_date(F.col(f"`{c}`"), fmt) for c in columns})


def format_timestamps(df: DataFrame, columns: Iterable[str] = (ADMIT_DATE, DISCHARGE_DATE), fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    """The two columns with their time of day; stays are then elapsed time."""
    return df.withColumns({c: parse_timestamp(F.col(f"`{c}`"), fmt) for c in columns})


def detected_format(df: DataFrame, column: str, order_col: str = ROW_POS, formats: tuple[str, ...] = KNOWN_FORMATS) -> Column:
    """Place of the format of the column's first value that has a known one
    (least `order_col`), as a scalar subquery; NULL when no value has."""
    number = format_number(F.col(f"`{column}`"), formats)
    return df.where(number.isNotNull()).agg(F.min_by(number, F.col(order_col)).alias("f")).scalar()


def format_dates_detected(df: DataFrame, columns: Iterable[str] = (ADMIT_DATE, DISCHARGE_DATE), order_col: str = ROW_POS,
                          formats: tuple[str, ...] = KNOWN_FORMATS) -> DataFrame:
    """Each column by the format that its first value has; values in another one are NULL."""
    return df.withColumns({c: parse_date_as(F.col(f"`{c}`"), detected_format(df, c, order_col, formats), formats) for c in columns})


def _keep(name: str, df: DataFrame) -> DataFrame:
    return df


def cleaning_stages(raw: DataFrame, outlier_column: str = BILLING, threshold: float = OUTLIER_THRESHOLD,
                    date_format: str | tuple[str, ...] = DATE_FORMAT, group_cols: Iterable[str] = (),
                    null_policy: str = "omit", timestamps: bool = False,
                    stage: Callable[[str, DataFrame], DataFrame] = _keep,
                    stage_rows: Callable[[str, DataFrame], DataFrame] | None = None) -> CleaningStages:
    """Every intermediate table of the run, lazily (nothing is computed).

    `stage("dedup", df)` is applied to the deduplicated rows and
    `stage("dated", df)` to the formatted ones, before the outlier step. A
    caller that writes them there (and reads them back) shuffles the raw rows
    once: the formatting, the z-score statistics and the filter then scan
    written tables, instead of each re-running the dedup. With `timestamps` the
    two dates keep their time of day (`date_format` is then one of timestamps).

    `stage_rows` is for callers that write everything. It gets the raw rows
    with their hash ("raw"), the hashes that several of them share, and then
    one table ("formatted") of the deduplicated rows, as they were and
    formatted, with their number of equal raw rows: `dedup`, `titled`, `dated`,
    `clean` and `copies` are scans of it. The statistics are its last table.
    """
    if timestamps:
        fmt = TIMESTAMP_FORMAT if date_format == DATE_FORMAT else date_format
        with_dates = lambda df: format_timestamps(df, fmt=fmt)
    else:
        with_dates = lambda df: format_dates(df, fmt=date_format)
    if stage_rows is None:
        dedup = stage("dedup", drop_duplicates(raw))
        titled = format_names(dedup)
        dated = stage("dated", with_dates(titled))
        clean = remove_outliers(dated, outlier_column, threshold, group_cols, null_policy)
        return CleaningStages(raw, dedup, titled, dated, clean)

    names = [c for c in raw.columns if c != ROW_POS]
    hashed = stage_rows("raw", with_row_hash(raw, names))
    rows = group_first(hashed, names, stage_rows, "raw")
    new = {c: f"_formatted_{i}" for i, c in enumerate((NAME, ADMIT_DATE, DISCHARGE_DATE))}
    asis = {c: f"_asis_{i}" for i, c in enumerate(new)}
    both = with_dates(format_names(rows.withColumns({asis[c]: F.col(f"`{c}`") for c in new})))
    held = stage_rows("formatted", both.withColumnsRenamed(new).withColumnsRenamed({asis[c]: c for c in new}))
    formatted = lambda which: held.select(*[F.col(new[c]).alias(c) if c in which else F.col(f"`{c}`") for c in raw.columns])
    dated = formatted(new)
    clean = remove_outliers(dated, outlier_column, threshold, group_cols, null_policy, stage_rows)
    return CleaningStages(raw, formatted(()), formatted((NAME,)), dated, clean, held.select(*raw.columns, COPIES))


def clean_encounters(raw: DataFrame, **options) -> DataFrame:
    """The cleaned table (same columns as the raw one, dates typed)."""
    return cleaning_stages(raw, **options).clean


def cleaning_report(stages: CleaningStages, outlier_column: str = BILLING,
                    threshold: float = OUTLIER_THRESHOLD, categories: Iterable[str] = CATEGORY_COLUMNS,
                    date_columns: Iterable[str] = (ADMIT_DATE, DISCHARGE_DATE),
                    group_cols: Iterable[str] = (), null_policy: str = "omit") -> DataFrame:
    """One long table of everything the run reports:
    step, metric, column_name, value (double), value_date (date).

    Four passes: the raw rows' groups of equal rows (`stages.copies`, where they
    are written) give the missing counts and the duplicates; one aggregate over the scored rows gives rows in /
    removed / saved and the date ranges of the saved rows; the statistics of the
    scores are the third; the grouping of `unique_values` gives the distinct
    category values.
    """
    dates, cats = list(date_columns), list(categories)
    names = [c for c in stages.raw.columns if c != ROW_POS]
    rows = outliers.scored(stages.dated, outlier_column, group_cols, null_policy)
    keep = outliers.kept(threshold)
    summary = rows.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(~keep).alias("rows_removed"),
        F.count_if(keep).alias("rows_saved"),
        *[F.min(F.when(keep, F.col(f"`{c}`"))).alias(f"_lo{i}") for i, c in enumerate(dates)],
        *[F.max(F.when(keep, F.col(f"`{c}`"))).alias(f"_hi{i}") for i, c in enumerate(dates)])
    if stages.copies is None:
        groups = stages.raw.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    else:
        groups = stages.copies.withColumnRenamed(COPIES, "_n")
    profile = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_dup"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("_in_groups"),
        *[F.coalesce(F.sum(F.when(is_missing(stages.raw, c), F.col("_n"))), F.lit(0)).alias(f"_m{i}") for i, c in enumerate(names)])
    entries = lambda *cells: F.array(*[F.struct(F.lit(step).alias("step"), F.lit(metric).alias("metric"),
                                                F.lit(name).cast("string").alias("column_name"), value.cast("double").alias("value"),
                                                F.lit(None).cast("date").alias("value_date")) for step, metric, name, value in cells])
    parts = [
        profile.select(F.inline(entries(
            *[("missing", "missing_count", c, F.col(f"_m{i}")) for i, c in enumerate(names)],
            *[("missing", "missing_pct", c, pct_of(f"_m{i}", "_rows")) for i, c in enumerate(names)],
            ("duplicates", "rows", None, F.col("_rows")), ("duplicates", "duplicates", None, F.col("_dup")),
            ("duplicates", "rows_in_groups", None, F.col("_in_groups"))))),
        summary.select(F.inline(F.array(
            *[F.struct(F.lit(step).alias("step"), F.lit(metric).alias("metric"),
                       F.lit(col).cast("string").alias("column_name"), F.col(src).cast("double").alias("value"),
                       F.lit(None).cast("date").alias("value_date"))
              for step, metric, col, src in (("outliers", "rows_in", outlier_column, "rows_in"),
                                             ("outliers", "rows_removed", outlier_column, "rows_removed"),
                                             ("save", "rows", None, "rows_saved"))],
            *[F.struct(F.lit("date_range").alias("step"), F.lit(bound).alias("metric"),
                       F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("value"),
                       F.col(f"_{tag}{i}").alias("value_date"))
              for i, c in enumerate(dates) for bound, tag in (("earliest", "lo"), ("latest", "hi"))]))),
    ]
    if cats:
        distinct = unique_values(stages.dated, cats).groupBy("column_name").agg(F.count(F.lit(1)).cast("double").alias("value"))
        parts.append(distinct.select(F.lit("unique").alias("step"), F.lit("distinct_values").alias("metric"), "column_name", "value",
                                     F.lit(None).cast("date").alias("value_date")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
