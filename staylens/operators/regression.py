"""Least squares on numeric and one-hot encoded columns, from sums.

The rows are grouped by their categories and each group keeps its count,
sums and cross products (partial aggregates, one shuffle of a few rows); the
normal equations are put together from these, so the cost on the rows does
not depend on the number of one-hot columns. Numeric columns are centred and
scaled first, with the moments of one pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values that a categorical column may have, and combinations of them.
MAX_LEVELS, MAX_GROUPS = 1000, 100_000
#: A column that the ones before it explain up to this share of its square is collinear.
COLLINEAR = 1e-9


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Design:
    """Columns of a design matrix; of each categorical one, the first level
    (in the order of its values) is the reference."""
    numeric: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]

    @property
    def columns(self) -> list[str]:
        return [*self.levels, *self.numeric]

    def terms(self) -> list[tuple[str, Column]]:
        """(name, value) of every column but the intercept, as doubles."""
        out = [(f"{c}={v}", (_q(c) == F.lit(v)).cast("double")) for c, values in self.levels.items() for v in values[1:]]
        return out + [(c, _q(c).cast("double")) for c in self.numeric]


def design_of(df: DataFrame, numeric: Iterable[str] = (), categorical: Iterable[str] = ()) -> Design:
    """The design of these columns; more than MAX_LEVELS values in a categorical one are an error."""
    levels = {}
    for c in categorical:
        values = [r[0] for r in df.where(_q(c).isNotNull()).select(_q(c).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(values) > MAX_LEVELS:
            raise ValueError(f"{c}: more than {MAX_LEVELS} values")
        levels[c] = tuple(sorted(values))
    return Design(tuple(numeric), levels)


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Coefficients of the normal equations; NaN for columns that those before
    them explain (they count as left out)."""
    m = np.column_stack([gram, right]).astype(float)
    out = np.full(len(right), np.nan)
    used: list[int] = []
    for k in range(len(right)):
        if m[k, k] <= COLLINEAR * max(gram[k, k], np.finfo(float).tiny):
            m[k] = 0.0
            m[:, k] = 0.0
            continue
        m[k] /= m[k, k]
        for i in range(len(right)):
            if i != k:
                m[i] -= m[i, k] * m[k]
        used.append(k)
    out[used] = m[used, -1]
    return out


def linear_regression(df: DataFrame, target: str, numeric: Iterable[str] = (), categorical: Iterable[str] = ()) -> DataFrame:
    """term, coefficient, n_rows, r_squared: one row per term, `(intercept)`
    first. Rows with NULL in a used column are left out. A collinear or constant
    column has a NULL coefficient; a constant target's r_squared is NULL; without
    rows every coefficient is NULL."""
    spark, design = df.sparkSession, design_of(df, numeric, categorical)
    number = [target, *design.numeric]
    rows = df.select(*(_q(c).cast("string").alias(f"g{i}") for i, c in enumerate(design.levels)),
                     *(_q(c).cast("double").alias(f"v{i}") for i, c in enumerate(number))).dropna()
    names = ["(intercept)", *(n for n, _ in design.terms())]
    moments = rows.agg(F.count(F.lit(1)), *(f(F.col(f"v{i}")) for i in range(len(number)) for f in (F.avg, F.stddev_pop))).first()
    n, mean, scale = moments[0], list(moments[1::2]), [s or 1.0 for s in moments[2::2]]
    if not n:
        return spark.createDataFrame([(t, None, 0, None) for t in names], "term string, coefficient double, n_rows bigint, r_squared double")
    v = [(F.col(f"v{i}") - mean[i]) / scale[i] for i in range(len(number))]
    pairs = [(i, j) for i in range(len(number)) for j in range(i, len(number))]
    sums = [F.count(F.lit(1)), *(F.sum(x) for x in v), *(F.sum(v[i] * v[j]) for i, j in pairs)]
    groups = rows.groupBy(*(f"g{i}" for i in range(len(design.levels)))).agg(*sums).limit(MAX_GROUPS + 1).collect()
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} combinations of {', '.join(design.levels)}")
    d = len(names)
    gram, right, total = np.zeros((d, d)), np.zeros(d), np.zeros((len(number), len(number)))
    place = {n: k for k, n in enumerate(names)}
    xs = slice(d - len(design.numeric), d)
    for g in groups:
        cats, (count, *rest) = g[:len(design.levels)], g[len(design.levels):]
        s = np.array(rest[:len(number)])
        on = [0, *(place[f"{c}={x}"] for c, x in zip(design.levels, cats) if f"{c}={x}" in place)]
        gram[np.ix_(on, on)] += count
        gram[on, xs] += s[1:]
        right[on] += s[0]
        for (i, j), x in zip(pairs, rest[len(number):]):
            total[i, j] += x
    gram[xs, :xs.start] = gram[:xs.start, xs].T
    gram[xs, xs] = total[1:, 1:] + np.triu(total[1:, 1:], 1).T
    right[xs] = total[0, 1:]
    beta = solve(gram, right)
    known = np.where(np.isnan(beta), 0.0, beta)
    left = total[0, 0] - known @ right
    r2 = None if moments[2] in (None, 0.0) else float(1 - left / total[0, 0])
    beta = beta * scale[0]
    beta[xs] = beta[xs] / np.array(scale[1:])
    beta[0] = mean[0] + (beta[0] if not np.isnan(beta[0]) else 0.0) - np.nansum(beta[xs] * np.array(mean[1:]))
    cells = [(t, None if np.isnan(b) else float(b), int(n), r2) for t, b in zip(names, beta)]
    return spark.createDataFrame(cells, "term string, coefficient double, n_rows bigint, r_squared double")
