"""z-score and outlier removal, over the whole table or per group.

Global statistics are a scalar subquery: one small aggregate job whose two
numbers are inlined into the row filter - no join and no single-partition
window. Per-group statistics are a grouped aggregate joined back on the
group keys; the aggregate is partial/final (a hot group is folded map-side)
and the join is planned by AQE (broadcast when the statistics are small,
skew-split otherwise).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.schemas import OUTLIER_THRESHOLD


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _stats_exprs(value: Column) -> list[Column]:
    return [F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"),
            F.count_if(value.isNull()).alias("_nulls")]


def _unstaged(name: str, df: DataFrame) -> DataFrame:
    return df


def with_stats(df: DataFrame, column: str, group_cols: Iterable[str] = (),
               stage: Callable[[str, DataFrame], DataFrame] = _unstaged) -> DataFrame:
    """Attach mean, population std and null count of `column` as _mean, _std,
    _nulls (per group when `group_cols` are given). `stage("stats", df)` is
    applied to the statistics: a caller that writes them takes them once for
    all later scans of the rows."""
    raw = _q(column).cast("double")
    value = F.when(F.isnan(raw), F.lit(None)).otherwise(raw)
    groups = list(group_cols)
    if not groups:
        stats = stage("stats", df.agg(F.struct(*_stats_exprs(value)).alias("s"))).scalar()
        return (df.withColumn("_s", stats)
                .withColumns({"_mean": F.col("_s._mean"), "_std": F.col("_s._std"), "_nulls": F.col("_s._nulls")})
                .drop("_s"))
    keyed = [_q(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    stats = stage("stats", df.groupBy(*keyed).agg(*_stats_exprs(value)))
    cond = [_q(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    return df.join(stats, cond, "left").drop(*[f"_g{i}" for i in range(len(groups))])


def zscore_expr(column: str, null_policy: str = "omit") -> Column:
    """z = (x - mean) / std_pop over a frame that carries `with_stats`.

    Zero variance gives NULL, not an error. `null_policy="omit"`: NULL rows
    get NULL and the rest are judged on the non-null values;
    `"propagate"`: one missing value makes every z NULL.
    """
    z = F.try_divide(_q(column).cast("double") - F.col("_mean"), F.col("_std"))
    z = F.when(F.isnan(_q(column).cast("double")), F.lit(None)).otherwise(z)
    if null_policy == "propagate":
        return F.when(F.col("_nulls") > 0, F.lit(None).cast("double")).otherwise(z)
    if null_policy != "omit":
        raise ValueError(f"null_policy must be 'omit' or 'propagate', not {null_policy!r}")
    return z


def zscore(df: DataFrame, column: str, group_cols: Iterable[str] = (), null_policy: str = "omit",
           name: str = "z_score") -> DataFrame:
    """Add the z-score of `column` (population std)."""
    return (with_stats(df, column, group_cols)
            .withColumn(name, zscore_expr(column, null_policy))
            .drop("_mean", "_std", "_nulls"))


def _keep(threshold: float) -> Column:
    return F.coalesce(F.abs(F.col("_z")) <= F.lit(float(threshold)), F.lit(False))


def scored(df: DataFrame, column: str, group_cols: Iterable[str] = (), null_policy: str = "omit",
           stage: Callable[[str, DataFrame], DataFrame] = _unstaged) -> DataFrame:
    """Rows with their z-score in `_z` (and the statistics used)."""
    return with_stats(df, column, group_cols, stage).withColumn("_z", zscore_expr(column, null_policy))


def kept(threshold: float = OUTLIER_THRESHOLD) -> Column:
    """Over `scored` rows: true where the row survives the outlier filter."""
    return _keep(threshold)


def remove_outliers(df: DataFrame, column: str, threshold: float = OUTLIER_THRESHOLD,
                    group_cols: Iterable[str] = (), null_policy: str = "omit",
                    stage: Callable[[str, DataFrame], DataFrame] = _unstaged) -> DataFrame:
    """Rows with |z| <= threshold (inclusive); rows whose z is NULL go too."""
    rows = scored(df, column, group_cols, null_policy, stage)
    return rows.where(_keep(threshold)).drop("_mean", "_std", "_nulls", "_z")


def outlier_rows(df: DataFrame, column: str, threshold: float = OUTLIER_THRESHOLD,
                 group_cols: Iterable[str] = (), null_policy: str = "omit", name: str = "z_score") -> DataFrame:
    """The rows `remove_outliers` removes, with their z-score."""
    return (scored(df, column, group_cols, null_policy).where(~_keep(threshold)).withColumnRenamed("_z", name)
            .drop("_mean", "_std", "_nulls"))


def outlier_report(df: DataFrame, column: str, threshold: float = OUTLIER_THRESHOLD,
                   group_cols: Iterable[str] = (), null_policy: str = "omit") -> DataFrame:
    """Rows in, kept and removed, with the mean and std used (per group)."""
    groups = list(group_cols)
    return (scored(df, column, groups, null_policy).groupBy(*[_q(g) for g in groups])
            .agg(F.count(F.lit(1)).alias("rows_in"),
                 F.count_if(_keep(threshold)).alias("rows_kept"),
                 F.count_if(~_keep(threshold)).alias("rows_removed"),
                 F.first("_mean").alias("mean"),
                 F.first("_std").alias("std")))
