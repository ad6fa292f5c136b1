"""Pairwise correlations of numeric columns, over the table or per group, in
one aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def correlations(df: DataFrame, columns: Iterable[str], group_cols: Iterable[str] = ()) -> DataFrame:
    """Per pair of columns (and group): column_a, column_b, n_rows (rows with
    both), covar_pop, corr. A row counts for the pairs it has both values of
    (NaN is missing). Without rows covar_pop and corr are NULL; corr is NULL too
    where one of the two does not vary. Rows with a NULL group key go."""
    groups, names = list(group_cols), list(columns)
    for g in groups:
        df = df.where(_q(g).isNotNull())
    cells = []
    for a, b in combinations(names, 2):
        x, y = _q(a).cast("double"), _q(b).cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        x, y = F.when(both, x), F.when(both, y)
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))      # corr() itself stops at a column that does not vary
        cells.append((a, b, F.count(x), F.covar_pop(x, y), F.when(varies, corr)))
    sums = [c.alias(f"_{k}_{i}") for i, cell in enumerate(cells) for k, c in zip("nvc", cell[2:])]
    agg = df.groupBy(*(_q(g) for g in groups)).agg(*sums)
    rows = F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_n_{i}").alias("n_rows"),
                              F.col(f"_v_{i}").alias("covar_pop"), F.col(f"_c_{i}").alias("corr")) for i, (a, b, *_) in enumerate(cells)))
    return agg.select(*(_q(g) for g in groups), F.inline(rows))
