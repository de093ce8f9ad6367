"""The main chain of records that name their parents, by pointer jumping.

A chain ends at the last record that can be a leaf and goes by parents to a
root.  Records come in blocks (of a file, say), and most follow their parent at
once: such stretches of a block are contracted to a segment each, so pointers
are jumped between segments only, log2 of their number rounds.  A segment is
entered at some record, and left through its head to the head's parent.

Round k has, for each segment, the segment that is 2^k steps up and the record
at which it is entered.  The ancestors of the leaf are then marked from the
longest jumps down: each round adds to every marked segment the one that is 2^k
above it, so that all numbers of steps are there in the end.  A segment with an
ancestor as many steps up as there are segments is on a cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import table
from .ordered import running_sum


@dataclass
class Chains:
    """chain: group, block, at, stretch of each record on a chain, in the order of stretch and at; broken: the groups whose chain has a cycle or a parent that isn't there."""

    chain: DataFrame
    broken: DataFrame


def main_chains(records: DataFrame, group: str = "group") -> Chains:
    """The main chain of each group of records: group, block, at, uuid, parent, leaf (whether it can be one).

    Records are in the order of block and at.  Of records that repeat a uuid the
    last has it.  A group without a leaf is broken; one with a null uuid at some
    record doesn't have that record on a chain.
    """
    own = records.select(F.col(group).alias("g"), "block", "at", "uuid", "parent", "leaf").filter("uuid is not null")
    last = own.groupBy("g", "uuid").agg(F.max(F.struct("block", "at", "parent")).alias("r")).select("g", "uuid", "r.*")
    within = Window.partitionBy("g", "block").orderBy("at")
    follows = F.coalesce(F.col("parent") == F.lag("uuid").over(within), F.lit(False))
    nodes = last.withColumn("head", ~follows).withColumn("seg", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(within))
    nodes = table(nodes, "chain-nodes")

    places = nodes.select(F.col("g").alias("pg"), F.col("uuid").alias("pu"), F.col("block").alias("tb"), F.col("seg").alias("ts"), F.col("at").alias("ta"))
    heads = nodes.filter("head").select("g", "block", "seg", "parent")
    # Tables here are small as files and large as rows: none of them goes through the driver to be broadcast.
    links = heads.join(places.hint("merge"), (F.col("g") == F.col("pg")) & (F.col("parent") == F.col("pu")), "left").drop("pg", "pu")
    links = table(links, "chain-links")
    most = links.groupBy("g").count().agg(F.max("count")).first()[0] or 0

    jumps = [links.filter("tb is not null").select("g", "block", "seg", "tb", "ts", "ta")]
    while 2 ** (len(jumps) - 1) < most:
        low, high = jumps[-1].alias("l"), jumps[-1].alias("h")
        on = (F.col("l.g") == F.col("h.g")) & (F.col("l.tb") == F.col("h.block")) & (F.col("l.ts") == F.col("h.seg"))
        further = table(low.join(high.hint("merge"), on).select("l.g", "l.block", "l.seg", "h.tb", "h.ts", "h.ta"), "chain-jumps")
        if further.isEmpty():
            break
        jumps.append(further)
    endless = 2 ** (len(jumps) - 1) >= most

    leaves = own.filter("leaf").groupBy("g").agg(F.max_by("uuid", F.struct("block", "at")).alias("uuid"))
    marks = table(nodes.join(leaves.hint("merge"), ["g", "uuid"]).select("g", "block", "seg", F.col("at").alias("cut"), F.lit(0).cast("long").alias("steps")), "chain-marks")
    cyclic = marks.join(jumps[-1], ["g", "block", "seg"], "left_semi").select("g") if endless and most else marks.select("g").limit(0)
    marks = marks.join(cyclic.hint("merge"), "g", "left_anti")
    for k in range(len(jumps) - 1, -1, -1):
        up = marks.join(jumps[k].hint("merge"), ["g", "block", "seg"]).select("g", F.col("tb").alias("block"), F.col("ts").alias("seg"), F.col("ta").alias("cut"), (F.col("steps") + 2**k).alias("steps"))
        marks = table(marks.unionByName(up), "chain-marks")
    ends = marks.groupBy("g").agg(F.max(F.struct("steps", "block", "seg")).alias("e")).select("g", "e.block", "e.seg")
    whole = ends.join(links.filter("parent is null").hint("merge"), ["g", "block", "seg"], "left_semi").select("g")
    chain = nodes.join(marks.join(whole.hint("merge"), "g", "left_semi").hint("merge"), ["g", "block", "seg"]).filter("at <= cut")
    broken = records.select(F.col(group).alias("g")).distinct().join(whole.hint("merge"), "g", "left_anti")
    return Chains(chain.select(F.col("g").alias(group), "block", "at", (-F.col("steps")).alias("stretch")), broken.withColumnRenamed("g", group))


def in_order(records: DataFrame, group: str = "group") -> DataFrame:
    """The records of each group's main chain, or all of a broken group in their own order: with stretch (in whose order and at's they come), broken and place from 0."""
    chains = main_chains(records, group)
    chain, broken = table(chains.chain, "chain"), table(chains.broken, "chain-broken")
    there = records.join(chain.hint("merge"), [group, "block", "at"]).withColumn("broken", F.lit(False))
    others = records.join(broken.hint("merge"), group, "left_semi").withColumn("stretch", F.col("block").cast("long")).withColumn("broken", F.lit(True))
    both = there.unionByName(others)
    return running_sum(both, [group], "stretch", "at", F.lit(1), "place").withColumn("place", F.col("place") - 1)
