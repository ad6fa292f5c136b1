"""Connected components of a link table, by alternating star steps.

Each step replaces links by links to the smallest known neighbour, so every
component shrinks to a star in a logarithmic number of rounds. Minima are
partial aggregates and joins are on single nodes, so a node with a third of
all links is folded before the shuffle, or split by AQE; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.shared import discard, written


def _to_least(links: DataFrame, both: bool) -> DataFrame:
    """Large-star (`both`): all neighbours of u that are above u go to u's least
    neighbour. Small-star: the neighbours below u, and u, do."""
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        pairs = pairs.union(pairs.select("v", "u"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each linked node's component.

    `links`: columns a, b, both not null, in any order; links to itself and
    repeated links do not matter. Nodes without links do not appear."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = last = None
    while True:
        links = written(_to_least(_to_least(links, both=True), both=False), "links")
        if last is not None:
            discard(last)
        last = links
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
