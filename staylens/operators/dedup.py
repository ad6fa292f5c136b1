"""Duplicate rows: count, list, drop (keep first), distinct on a subset.

Rows are equal when all compared columns are equal, NULL equal to NULL.
Everything is a grouping on the compared columns: map-side partial
aggregation folds a hot duplicate group before the shuffle, so no group is
ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.operators import keys as lookups
from staylens.schemas import ROW_POS

#: 64-bit hash of a row's compared columns; rows that are equal to it.
ROW_HASH = "_row_hash"
COPIES = "_copies"


def _q(name: str):
    return F.col(f"`{name}`")


def _keys(df: DataFrame, subset: Iterable[str] | None, order_col: str) -> list[str]:
    return list(subset) if subset is not None else [c for c in df.columns if c != order_col]


def duplicate_count(df: DataFrame, subset: Iterable[str] | None = None, order_col: str = ROW_POS) -> DataFrame:
    """One row: n_rows, n_distinct, n_duplicates (rows a keep-first drop
    removes) and n_in_groups (rows of groups with more than one row)."""
    keys = _keys(df, subset, order_col)
    groups = df.groupBy(*[_q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("long").alias("n_in_groups"),
    )


def drop_duplicates(df: DataFrame, subset: Iterable[str] | None = None, order_col: str = ROW_POS) -> DataFrame:
    """Keep the first row (lowest `order_col`) of each group of equal rows.

    With a subset, the other columns come from that first row.
    """
    keys = _keys(df, subset, order_col)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    if not rest:
        return (df.groupBy(*[_q(k) for k in keys]).agg(F.min(order_col).alias(order_col))
                .select(*df.columns))
    first = F.min(F.struct(F.col(order_col).alias("_o"), *[_q(c) for c in rest])).alias("_first")
    return (df.groupBy(*[_q(k) for k in keys]).agg(first)
            .select(*[_q(k) for k in keys], *[F.col(f"_first.`{c}`").alias(c) for c in rest],
                    F.col("_first._o").alias(order_col))
            .select(*df.columns))


def with_row_hash(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.withColumn(ROW_HASH, F.xxhash64(*[_q(k) for k in keys]))


def group_first(hashed: DataFrame, keys: Iterable[str], stage: Callable[[str, DataFrame], DataFrame], name: str,
                order_col: str = ROW_POS) -> DataFrame:
    """Distinct rows of `keys` with their lowest `order_col` and the number of
    rows that are equal (COPIES), for tables of mostly distinct rows.

    Rows that are equal share a hash, so a row that has its hash alone is
    distinct: only the hashes of such rows are shuffled, never the rows, and
    rows that share a hash are grouped on all their columns. `hashed` (with
    `with_row_hash`) is scanned three times. The shared hashes are written by
    `stage` and broadcast; when there are more than BROADCAST_MAX_ROWS of them,
    all rows are grouped on their columns."""
    cols = list(keys)

    def grouped(rows: DataFrame) -> DataFrame:
        return (rows.groupBy(*[_q(c) for c in cols])
                .agg(F.min(order_col).alias(order_col), F.count(F.lit(1)).alias(COPIES)))

    shared = stage(f"{name}-shared", hashed.groupBy(ROW_HASH).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > 1).select(ROW_HASH))
    n_shared = shared.count()
    if n_shared > lookups.BROADCAST_MAX_ROWS:
        return grouped(hashed)
    alone = hashed if n_shared == 0 else hashed.join(F.broadcast(shared), ROW_HASH, "left_anti")
    alone = alone.select(*[_q(c) for c in cols], _q(order_col), F.lit(1).cast("bigint").alias(COPIES))
    if n_shared == 0:
        return alone
    return alone.unionByName(grouped(hashed.join(F.broadcast(shared), ROW_HASH, "left_semi")))


def distinct_first(df: DataFrame, columns: Iterable[str], id_col: str, order_col: str = ROW_POS) -> DataFrame:
    """Distinct rows of `columns`, each with the position of its first
    appearance as `id_col`: unique and in insertion order, without a global
    sort (an autoincrement key in insertion order, up to gaps)."""
    cols = list(columns)
    return df.groupBy(*[_q(c) for c in cols]).agg(F.min(order_col).alias(id_col)).select(id_col, *cols)


def distinct_first_staged(df: DataFrame, columns: Iterable[str], id_col: str, stage: Callable[[str, DataFrame], DataFrame],
                          name: str, order_col: str = ROW_POS) -> DataFrame:
    """`distinct_first` for rows that are mostly distinct, by `group_first`."""
    cols = list(columns)
    hashed = with_row_hash(df.select(*[_q(c) for c in cols], _q(order_col)), cols)
    return group_first(hashed, cols, stage, name, order_col).select(_q(order_col).alias(id_col), *cols)


def duplicate_rows(df: DataFrame, subset: Iterable[str] | None = None, order_col: str = ROW_POS) -> DataFrame:
    """All rows of every group of equal rows (no row of a group is kept out).

    The keys of groups with more than one row are found by a grouping, then
    the rows are picked by a semi join (split by AQE when one key is hot) on a
    64-bit hash and the whole row as one struct (NULL equal to NULL in it),
    not by a window that would hold a whole group in one task.
    """
    keys = _keys(df, subset, order_col)
    row = F.struct(*[_q(k).alias(f"c{i}") for i, k in enumerate(keys)])
    dup_keys = (df.groupBy(*[_q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).select(F.xxhash64(*[_q(k) for k in keys]).alias("_hash"), row.alias("_row")))
    same = (F.xxhash64(*[_q(k) for k in keys]) == F.col("_hash")) & (row == F.col("_row"))
    return df.join(dup_keys, same, "left_semi")
