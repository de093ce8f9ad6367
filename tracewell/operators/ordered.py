"""Positions and sums along an order within groups of any size.

A window over a whole group is one task's work.  Where rows come in blocks that
follow one another, a block is one window, a row for each block is another, and
the block's start goes back to its rows.  Blocks must be small; groups needn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_blocks(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    renamed = blocks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return rows.join(renamed.hint("merge"), same, "left").drop(*[f"_of_{k}" for k in keys])


def previous(rows: DataFrame, group: list[str], block: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with name: the value of the row before in the group, null for the first."""
    keys = [*group, block]
    own = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_value", value)
    rows = rows.withColumn(name, F.lag("_value").over(own)).withColumn("_first", F.row_number().over(own) == 1)
    last = rows.groupBy(*keys).agg(F.max_by("_value", order).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*group).orderBy(block))).drop("_last")
    joined = _with_blocks(rows, last, keys)
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name))).drop("_value", "_first", "_before")


def running_sum(rows: DataFrame, group: list[str], block: str, order: str | list[str], value: Column, name: str) -> DataFrame:
    """rows with name: the sum of value up to and with the row, in its group."""
    keys, order = [*group, block], [order] if isinstance(order, str) else order
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    joined = _with_blocks(rows.withColumn("_inside", F.sum(value).over(inside)), starts, keys)
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")
