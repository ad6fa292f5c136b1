"""Monthly volume series, least-squares trend and compound-growth forecast.

Every step works per series (`group_cols`), so one call fits thousands of
series in parallel. Only the first step touches row-level data (a grouped
distinct count); the rest runs on one row per series-month. Month spines
and horizons are generated with `sequence` + `explode` from one row per
series, and empty months are looked up in its map of counts - no join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.dates import month_index
from staylens.functions.numeric import pct_change
from staylens.schemas import FORECAST_HORIZON, FORECAST_WINDOWS, GROWTH_FACTORS, monthly_growth_rate


def _not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def _keep(name: str, df: DataFrame) -> DataFrame:
    return df


def monthly_counts(df: DataFrame, date_col: str = "admission_date", entity: str = "patient_id",
                   group_cols: Iterable[str] = (), drop_last: bool = True, approx: bool = False,
                   end: date | None = None, per_series_end: bool = False,
                   stage: Callable[[str, DataFrame], DataFrame] = _keep) -> DataFrame:
    """Distinct entities per calendar month, empty months filled with 0,
    ordered by series and month.

    Each series runs from its first month to the last month of the whole
    table (`end`: any day of another last month; `per_series_end`: each
    series' own last month). With `drop_last` that month, which may be
    incomplete, is left out. Columns: *group_cols, month_end (date), k
    (0-based month number in the series), n_patients (long).

    Only the grouped distinct count touches rows; `stage("monthly", counts)`
    is applied to it. Gaps are filled within one row per series.
    """
    groups = list(group_cols)
    distinct = F.approx_count_distinct(entity) if approx else F.count_distinct(entity)
    counts = stage("monthly", df.where(F.col(date_col).isNotNull())
                   .groupBy(*groups, month_index(F.col(date_col)).alias("_month")).agg(distinct.alias("_n")))
    last = (F.max("_month") if per_series_end else
            F.lit(end.year * 12 + end.month - 1) if end is not None else
            F.first(counts.agg(F.max("_month")).scalar()))
    months = (counts.where(_not_null(groups)).groupBy(*groups)
              .agg(F.map_from_entries(F.collect_list(F.struct("_month", "_n"))).alias("_counts"),
                   F.min("_month").alias("_first"), last.alias("_last")))
    stop = F.col("_last") - 1 if drop_last else F.col("_last")
    spine = months.where(stop >= F.col("_first")).select(
        *groups, "_counts", "_first", F.explode(F.sequence("_first", stop)).alias("_month"))
    first_day = F.make_date((F.col("_month") / 12).cast("int"), F.col("_month") % 12 + 1, F.lit(1))
    return (spine.select(*groups, F.last_day(first_day).alias("month_end"),
                         (F.col("_month") - F.col("_first")).cast("int").alias("k"),
                         F.coalesce(F.col("_counts")[F.col("_month")], F.lit(0)).cast("long").alias("n_patients"))
            .orderBy(*groups, "month_end"))


def linear_fit(series: DataFrame, y: str = "n_patients", x: str = "k",
               group_cols: Iterable[str] = ()) -> DataFrame:
    """Ordinary least squares y = intercept + slope * x per series.

    Columns: *group_cols, n_months, slope, intercept, std_y (population),
    mean_y, last_month_end. One point: slope 0, intercept y. An empty series
    gives no row.
    """
    groups = list(group_cols)
    yd, xd = F.col(y).cast("double"), F.col(x).cast("double")
    fit = series.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.regr_slope(yd, xd).alias("_slope"),
        F.regr_intercept(yd, xd).alias("_intercept"),
        F.stddev_pop(yd).alias("std_y"),
        F.avg(yd).alias("mean_y"),
        F.max("month_end").alias("last_month_end"),
    )
    return (fit.where(F.col("n_months") > 0)
            .select(*groups, "n_months",
                    F.coalesce("_slope", F.lit(0.0)).alias("slope"),
                    F.coalesce("_intercept", F.col("mean_y")).alias("intercept"),
                    "std_y", "mean_y", "last_month_end"))


def _forecast_rows(fit: DataFrame, groups: Sequence[str], horizon: int, factors) -> DataFrame:
    rate = float(monthly_growth_rate(factors))
    k = F.col("k")
    x = (F.col("n_months") + k).cast("double")
    base = F.col("intercept") + F.col("slope") * x
    growth = F.pow(F.lit(1.0 + rate), k.cast("double"))
    band = F.col("std_y") * F.sqrt(F.lit(1.0) + k.cast("double") / F.col("n_months").cast("double"))
    return (fit.select(*groups, "n_months", "slope", "intercept", "std_y", "mean_y", "last_month_end",
                       F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("k"))
            .withColumn("month_end", F.last_day(F.add_months("last_month_end", k + 1)))
            .withColumn("base", base)
            .withColumn("growth", growth)
            .withColumn("value", F.col("base") * F.col("growth"))
            .withColumn("_band", band)
            .withColumn("lower", F.col("value") - F.col("_band"))
            .withColumn("upper", F.col("value") + F.col("_band")))


def forecast(fit: DataFrame, group_cols: Iterable[str] = (), horizon: int = FORECAST_HORIZON,
             factors=GROWTH_FACTORS) -> DataFrame:
    """Trend extrapolated `horizon` months past the history, times compound
    growth (1 + annual/12)^k (k = 0 gives factor 1), with a band of
    std_y * sqrt(1 + k / n) around it.

    Columns: *group_cols, k, month_end, base, growth, value, lower, upper.
    """
    groups = list(group_cols)
    return _forecast_rows(fit, groups, horizon, factors).select(
        *groups, "k", "month_end", "base", "growth", "value", "lower", "upper")


def forecast_summary(fit: DataFrame, group_cols: Iterable[str] = (), horizon: int = FORECAST_HORIZON,
                     factors=GROWTH_FACTORS, windows=FORECAST_WINDOWS, labels: bool = False,
                     carry: Iterable[str] = ()) -> DataFrame:
    """Current monthly mean, mean forecast in each window and % change.

    Columns: *group_cols, *carry (columns of the fit), current_avg, predicted_<w>, growth_<w> per window
    (default 1yr = months 0-11, 5yr = 48-59, 10yr = 108-119).
    """
    groups = list(group_cols)
    rows = _forecast_rows(fit, groups, horizon, factors)
    aggs = [*(F.first(c).alias(c) for c in carry), F.first("mean_y").alias("current_avg")]
    for name, lo, hi in windows:
        aggs.append(F.avg(F.when(F.col("k").between(lo, hi), F.col("value"))).alias(f"predicted_{name}"))
    out = rows.groupBy(*groups).agg(*aggs)
    for name, _, _ in windows:
        out = out.withColumn(f"growth_{name}", pct_change(f"predicted_{name}", "current_avg"))
    if labels:
        from staylens.functions.labels import count_label, fixed, signed_pct
        out = out.withColumn("current_label", count_label(fixed("current_avg", 0)))
        for name, _, _ in windows:
            out = (out.withColumn(f"predicted_{name}_label",
                                  count_label(fixed(f"predicted_{name}", 0)))
                   .withColumn(f"growth_{name}_label", signed_pct(f"growth_{name}")))
    return out


def forecast_series(history: DataFrame, fc: DataFrame, group_cols: Iterable[str] = ()) -> DataFrame:
    """History and forecast as one series: *group_cols, month_end, kind
    ('history' / 'forecast'), value, lower, upper (NULL band on history)."""
    groups = list(group_cols)
    hist = history.select(*groups, "month_end", F.lit("history").alias("kind"),
                          F.col("n_patients").cast("double").alias("value"),
                          F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    fut = fc.select(*groups, "month_end", F.lit("forecast").alias("kind"), "value", "lower", "upper")
    return hist.unionByName(fut)
