"""Group reports over the encounter view: means, distinct counts, top-k,
row-percent contingency tables, headline KPIs.

Group keys that are NULL are left out (a grouping report of categories has no
NULL category) unless `keep_null_groups=True`. Every aggregate is
partial/final, so a hot group is folded map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.labels import count_label, fixed, money, thousands
from staylens.functions.numeric import pct_of, round_half_even


def _groups(df: DataFrame, keys: Sequence[str], keep_null_groups: bool) -> DataFrame:
    if keep_null_groups:
        return df
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def group_mean(df: DataFrame, key: str | Sequence[str], value: str, name: str = "mean",
               digits: int | None = 2, keep_null_groups: bool = False) -> DataFrame:
    """Mean of `value` per group, rounded half-to-even to `digits`."""
    keys = [key] if isinstance(key, str) else list(key)
    mean = F.avg(value)
    if digits is not None:
        mean = round_half_even(mean, digits)
    return _groups(df, keys, keep_null_groups).groupBy(*keys).agg(mean.alias(name))


def cost_by_group(df: DataFrame, key: str = "gender", value: str = "total_charges",
                  labels: bool = False, keep_null_groups: bool = False) -> DataFrame:
    """Mean charge per group to the cent, by key: key, avg_cost [, avg_cost_label]."""
    out = group_mean(df, key, value, "avg_cost", 2, keep_null_groups).orderBy(key)
    return out.withColumn("avg_cost_label", money("avg_cost")) if labels else out


def stay_by_group(df: DataFrame, key: str = "medical_condition", stay: str = "length_of_stay",
                  entity: str = "patient_id", labels: bool = False, keep_null_groups: bool = False,
                  approx: bool = False) -> DataFrame:
    """Mean stay and distinct entities per group, ascending by mean stay:
    key, avg_los, n_patients [, n_patients_label]."""
    distinct = F.approx_count_distinct(entity) if approx else F.count_distinct(entity)
    out = (_groups(df, [key], keep_null_groups).groupBy(key)
           .agg(F.avg(stay).alias("avg_los"), distinct.alias("n_patients"))
           .orderBy("avg_los", key))
    return out.withColumn("n_patients_label", count_label("n_patients")) if labels else out


def distinct_by_group(df: DataFrame, key: str = "doctor", entity: str = "patient_id",
                      name: str = "n_patients", keep_null_groups: bool = False,
                      approx: bool = False) -> DataFrame:
    """Distinct entities per group."""
    distinct = F.approx_count_distinct(entity) if approx else F.count_distinct(entity)
    return _groups(df, [key], keep_null_groups).groupBy(key).agg(distinct.alias(name))


def top_k(df: DataFrame, by: str, k: int, tie_break: Iterable[str] = (), ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) `by`; ties broken by
    `tie_break` ascending so the edge is stable. Planned as a per-partition
    top-k and one merge of k rows per partition (TakeOrderedAndProject)."""
    order = [F.col(by).asc() if ascending else F.col(by).desc()] + [F.col(c).asc() for c in tie_break]
    return df.orderBy(*order).limit(k)


def top_groups(df: DataFrame, key: str = "doctor", entity: str = "patient_id", k: int = 10,
               keep_null_groups: bool = False) -> DataFrame:
    """Top-k groups by distinct entities: key, n_patients (ties: key ascending)."""
    return top_k(distinct_by_group(df, key, entity, keep_null_groups=keep_null_groups), "n_patients", k, [key])


def crosstab_pct(df: DataFrame, row: str = "medical_condition", col: str = "admission_type") -> DataFrame:
    """Row-percent contingency table in long form, by row and column: row, col, n_rows, pct.

    Counts rows (not entities); pairs with a NULL on either side are left
    out; each row's pct sums to 100. The window runs over the aggregated
    pairs (one row per pair), never over the input rows.
    """
    pairs = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
             .groupBy(row, col).agg(F.count(F.lit(1)).alias("n_rows")))
    total = F.sum("n_rows").over(Window.partitionBy(row))
    return pairs.withColumn("pct", pct_of("n_rows", total)).orderBy(row, col)


def crosstab_pct_wide(df: DataFrame, row: str = "medical_condition", col: str = "admission_type",
                      values: Sequence[str] | None = None) -> DataFrame:
    """Row-percent contingency table, one column per `col` value (0 where a
    pair does not occur), by row. Percentages are of all the row's pairs, also
    those of values that are not listed. Without `values`, Spark finds the
    distinct column values first (more than spark.sql.pivotMaxValues raise)."""
    pairs = crosstab_pct(df, row, col)
    return (pairs.groupBy(row).pivot(col, list(values) if values is not None else None)
            .agg(F.first("pct")).na.fill(0.0).orderBy(row))


def kpis(df: DataFrame, entity: str = "patient_id", stay: str = "length_of_stay",
         cost: str = "total_charges", labels: bool = True, approx: bool = False,
         group_cols: Iterable[str] = (), keep_null_groups: bool = False) -> DataFrame:
    """Headline cards in one pass: total_patients, avg_stay, avg_cost and
    their label text ('1,500', '15.6 days', '$136,658.24'); one row, or one
    row per group."""
    groups = list(group_cols)
    distinct = F.approx_count_distinct(entity) if approx else F.count_distinct(entity)
    out = (_groups(df, groups, keep_null_groups).groupBy(*groups)
           .agg(distinct.alias("total_patients"), F.avg(stay).alias("avg_stay"), F.avg(cost).alias("avg_cost")))
    if not labels:
        return out
    return out.withColumns({
        "total_patients_label": thousands("total_patients"),
        "avg_stay_label": fixed("avg_stay", 1, " days"),
        "avg_cost_label": money("avg_cost"),
    })


def load_summary(df: DataFrame, entity: str = "patient_id") -> DataFrame:
    """Rows, columns and distinct entities of a loaded table."""
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_patients"))
            .withColumn("n_columns", F.lit(len(df.columns))))
