"""Types of text columns, from one aggregate over all values.

Every type is tried on every value that is not a missing-value token; a
column gets the first type, from the narrowest on, with no more misfits than
allowed. Patterns and casts decide, so `NA` among numbers leaves a number
column and `12abc` does not make one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import with_null_tokens
from staylens.schemas import DATE_FORMAT, NA_TOKENS, ROW_POS

_INT = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _fits(value: Column, date_format: str) -> list[tuple[str, Column]]:
    """(type, does the value have it), the narrowest first."""
    text = F.trim(value)
    whole = text.rlike(_INT)
    return [("boolean", F.lower(text).isin("true", "false")),
            ("int", whole & text.try_cast("int").isNotNull()),
            ("bigint", whole & text.try_cast("bigint").isNotNull()),
            ("double", text.rlike(_NUMBER)),
            ("date", F.try_to_date(text, date_format).isNotNull()),
            ("string", F.lit(True))]


def infer_types(text: DataFrame, tokens: Iterable[str] = NA_TOKENS, max_bad: float = 0.0,
                date_format: str = DATE_FORMAT, skip: Iterable[str] = (ROW_POS,)) -> DataFrame:
    """column_name, type, n_values (not missing), n_missing, n_bad (values that
    are not of the type). `max_bad`: the share of values that may be misfits. A
    column without values is a string column; an empty table has no rows.

    Columns are unpivoted and grouped by name: one pass, partial aggregates."""
    left_out = set(skip)
    cols = [c for c in text.columns if c not in left_out]
    known = with_null_tokens(text, cols, tokens)
    cells = known.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), _q(c).alias("v")) for c in cols))))
    value = F.col("v")
    types = [t for t, _ in _fits(value, date_format)]
    sums = cells.groupBy("column_name").agg(
        F.count("v").alias("n_values"), F.count_if(value.isNull()).alias("n_missing"),
        *[F.count_if(value.isNotNull() & ~F.coalesce(ok, F.lit(False))).alias(f"_{t}") for t, ok in _fits(value, date_format)])
    kind, bad = F.lit("string"), F.lit(0).cast("bigint")
    for t in reversed(types[:-1]):
        good = (F.col("n_values") > 0) & (F.col(f"_{t}") <= F.col("n_values") * F.lit(float(max_bad)))
        kind, bad = F.when(good, F.lit(t)).otherwise(kind), F.when(good, F.col(f"_{t}")).otherwise(bad)
    return sums.select("column_name", kind.alias("type"), "n_values", "n_missing", bad.alias("n_bad"))


def typed(text: DataFrame, types: DataFrame, tokens: Iterable[str] = NA_TOKENS, date_format: str = DATE_FORMAT) -> DataFrame:
    """`text` with each column cast to the type that `infer_types` gave it (a few
    rows, collected); misfits and missing values are NULL."""
    kinds = {r["column_name"]: r["type"] for r in types.collect()}
    known = with_null_tokens(text, list(kinds), tokens)

    def cast(c: str, kind: str) -> Column:
        value = F.trim(_q(c))
        return F.try_to_date(value, date_format) if kind == "date" else _q(c) if kind == "string" else value.try_cast(kind)

    return known.withColumns({c: cast(c, k) for c, k in kinds.items()})
