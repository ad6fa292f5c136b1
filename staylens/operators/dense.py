"""Dense ids 1..n in the order of a column, without a global sort in one task.

The rows are range-partitioned and sorted within their partitions, and
written with their partition and place; the partitions' sizes, one row each,
give every partition's offset. Ids are then a sum of two columns, the same on
every read of what was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.operators.keys import BROADCAST_MAX_ROWS

#: Partitions whose running sums are taken in one task.
PARTS_AT_ONCE = 1024
_PLACE_BITS = 33


def _q(name: str):
    return F.col(f"`{name}`")


def running_offsets(sizes: DataFrame, part: str = "part", n: str = "n") -> DataFrame:
    """Rows of all parts before each part. Sums run within blocks of
    PARTS_AT_ONCE parts, and over the blocks' totals, which are one array."""
    block = F.floor(F.col(part) / PARTS_AT_ONCE).cast("bigint")
    sizes = sizes.select(F.col(part).alias("part"), F.col(n).cast("bigint").alias("n"), block.alias("block"))
    totals = sizes.groupBy("block").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("block", "n")).alias("t")).scalar()
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.aggregate(F.filter("_totals", lambda x: x["block"] < F.col("block")), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return (sizes.withColumns({"_inside": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_totals": totals})
            .select("part", (F.col("_inside") + earlier).alias("offset")))


def dense_ids(df: DataFrame, order_col: str, id_col: str, stage: Callable[[str, DataFrame], DataFrame],
              name: str = "ranged", start: int = 1) -> DataFrame:
    """`df` with `id_col` = start, start + 1, ... in the order of `order_col`
    (unique; rows with equal values would be numbered in any order). `stage`
    writes a table under a name and reads it back: the ids belong to what it
    wrote, so two reads agree."""
    ranged = df.repartitionByRange(_q(order_col)).sortWithinPartitions(_q(order_col)).withColumn("_at", F.monotonically_increasing_id())
    held = stage(name, ranged)
    part = F.shiftright("_at", _PLACE_BITS)
    offsets = running_offsets(held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    bound = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))      # of a range partitioning
    offsets = offsets.withColumnRenamed("part", "_part")
    rows = held.withColumn("_part", part).join(F.broadcast(offsets) if bound <= BROADCAST_MAX_ROWS else offsets, "_part")
    return rows.withColumn(id_col, F.lit(start).cast("bigint") + F.col("offset") + place).drop("_part", "_at", "offset")
