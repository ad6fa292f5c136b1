"""Key rules of the normalised tables: NOT NULL split and orphan report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _all_present(columns: Iterable[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"`{c}`").isNotNull()
    return cond


def split_not_null(df: DataFrame, columns: Iterable[str], on_bad: str = "quarantine", table: str = "table"):
    """(good, quarantine): rows with every key column present, and the rest.

    A table with NOT NULL keys takes the good rows; the quarantine keeps the
    others whole for inspection. `on_bad="fail"` raises when there are such
    rows (one `limit 1` probe).
    """
    cols = list(columns)
    if on_bad not in ("quarantine", "fail"):
        raise ValueError(f"on_bad must be 'quarantine' or 'fail', not {on_bad!r}")
    ok = _all_present(cols)
    if on_bad == "fail":
        check_no_nulls(df.where(~ok), table)
    return df.where(ok), df.where(~ok)


def not_null_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows that a NOT NULL split loads and quarantines, in one pass:
    loaded, quarantined."""
    ok = _all_present(list(columns))
    return df.agg(F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("quarantined"))


def check_no_nulls(quarantine: DataFrame, table: str = "table") -> None:
    """Raise when a quarantine holds rows (one `limit 1` probe, not a count)."""
    if quarantine.limit(1).count() > 0:
        raise ValueError(f"{table}: rows with NULL in NOT NULL columns")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose foreign key has no parent row (NULL keys are not
    orphans, as in SQL foreign keys). An anti join on the parent's keys."""
    pk = parent_key or key
    keys = parent.select(F.col(pk).alias("_pk"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_pk"), "left_anti")


#: A key bitmap is broadcast up to so many keys between its least and largest (64 MB).
BITMAP_MAX_SPAN = 1 << 29


def key_bitmap(parent: DataFrame, key: str) -> DataFrame:
    """The parent's keys (0 or more, whole numbers) as bits: bucket, bits; a row
    for each 32768 keys in a row, built from partial aggregates."""
    keys = parent.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    return (keys.groupBy(F.bitmap_bucket_number("_k").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_k")).alias("bits")))


def split_foreign_key(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None):
    """(loaded, quarantine): child rows whose key is NULL or has a parent row,
    and the orphans.

    The parent's keys become an exact bitmap. While it spans at most
    BITMAP_MAX_SPAN keys it is broadcast, so child rows are tested where they
    are read and none is shuffled; beyond, child rows meet it by bucket."""
    pk = parent_key or key
    span = parent.agg(F.min(pk).alias("lo"), F.max(pk).alias("hi")).first()
    if span["lo"] is not None and span["lo"] < 0:
        raise ValueError(f"{pk}: keys below 0")
    bits = key_bitmap(parent, pk).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    if (span["hi"] or 0) - (span["lo"] or 0) <= BITMAP_MAX_SPAN:
        bits = F.broadcast(bits)
    at = F.bitmap_bit_position(F.col(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = (child.join(bits, F.bitmap_bucket_number(F.col(key)) == F.col("_bucket"), "left")
              .withColumn("_ok", F.col(key).isNull() | known).drop("_bucket", "_bits"))
    return marked.where("_ok").drop("_ok"), marked.where("NOT _ok").drop("_ok")


def orphan_report(relations: Iterable[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """One row per relation (name, child, parent, key): relation, n_child,
    n_orphans. Both counts come from one left join, so a child is read once."""
    parts = []
    for name, child, parent, key in relations:
        keys = parent.select(F.col(key).alias("_pk")).distinct()
        joined = child.select(F.col(key).alias("_fk")).join(keys, F.col("_fk") == F.col("_pk"), "left")
        parts.append(joined.agg(F.count(F.lit(1)).alias("n_child"),
                                F.count_if(F.col("_fk").isNotNull() & F.col("_pk").isNull()).alias("n_orphans"))
                     .select(F.lit(name).alias("relation"), "n_child", "n_orphans"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
