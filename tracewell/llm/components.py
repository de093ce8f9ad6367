"""Connected components of a table of links, without gathering any on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, table

ROUNDS = 50


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root of every node of links: root is the least node of its component.

    Every round hangs each node, and the neighbours of each node, on the least
    neighbour; links of one component become a star after a number of rounds
    that grows with the logarithm of its diameter.  Links with a null end or
    to themselves say nothing.
    """

    def normal(pairs: DataFrame) -> DataFrame:
        return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def done(pairs: DataFrame) -> bool:
        """Whether the links are stars: no node hangs on two, none that hangs is hung on."""
        ends = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter((F.col("up") > 1) | (F.col("up") + F.col("low") > 1)).isEmpty()

    now = table(normal(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    for _ in range(ROUNDS):
        if done(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"), "k"), "least")
        # The neighbours of a hub don't meet in one task.
        hung = join_by_size(both, "u", least, "n", "k", 2 * now.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = table(normal(hung.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))), "links")
    else:
        raise RuntimeError(f"components aren't done after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
