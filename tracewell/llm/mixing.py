"""Mixes sources to target weights by Pareto order sampling.

Each source has a target in words.  All its documents get the same number of
certain whole copies; what is left of the target goes to a sample of fixed size
(in words) drawn with unequal probabilities: a document's inclusion probability
grows with the square root of its size, those that reach 1 are certain too, and
the others are ranked by Pareto's ratio, random odds over inclusion odds, of
which the least fill the target.

The ranking needs no sort of a source: words are counted in bins of the ratio,
the bin in which the target is reached is cut into narrower ones until few
ratios are in it, and only these are put in order.  What decides in the end is
one threshold for each source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_by_size, table

SEED = 20_011
BINS = 1024
#: Rows of the last bin that are put in order, unless they are of one ratio; and cuts at most (BINS to that power still counts exactly).
LAST_ROWS, CUTS = 4096, 5
#: Sources up to which the table of thresholds, a row each, is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Mix:
    """What the mix weighs: weights repeat over sources by code point (null last), share of all words, copies at most."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most_copies: float = 2.0


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def luck_of(id_col: str, text_col: str) -> Column:
    """A number strictly between 0 and 1 that hangs on id and text alone, so reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def base_rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.col(source_col).cast("string").alias("_source"), size_of(F.col(text_col)).alias("_size"), luck_of(id_col, text_col).alias("_luck"))


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """sizes, a row per _source, with _place: its number by code point from 0, null last. Ranges are counted, then numbered each from its own start."""
    order = F.col("_source").asc_nulls_last()
    rows = table(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part, row = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect())  # a row for each range
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    places = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return rows.join(F.broadcast(places), part == F.col("_part")).withColumn("_place", F.col("_start") + row).drop("_at", "_part", "_start")


def targets(base: DataFrame, mix: Mix) -> DataFrame:
    """_source, _rows, source_size, target: shares by weight, those above their cap stop there and the excess is shared again.

    That has one solution: every target is the lesser of its cap and weight
    times a level.  The level rises while the sources that reach their cap at it
    grow; each step is an aggregate over sources.
    """
    sizes = base.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("_place") % len(mix.weights) + 1).cast("int"))
    rows = table(numbered_sources(sizes).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(mix.most_copies)).drop("_place"), "mix-weights")
    whole, capped, level = (rows.agg(F.sum("source_size")).first()[0] or 0) * mix.share, -1, 0.0
    while True:
        full = F.col("cap") < F.col("w") * F.lit(level)
        n, words, left = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == capped:
            break
        capped, level = n, (whole - words) / left if left else float("inf")
    return rows.select("_source", "_rows", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def with_source(df: DataFrame, rows: DataFrame, n: int, total: int) -> DataFrame:
    """df, whose rows are no more than total, with the columns of rows, of which there are n, one per _source, with _rows of df."""
    right = rows.withColumnRenamed("_source", "_of")
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(right.drop("_rows")), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return join_by_size(df.withColumn("_key", key("_source")), "_key", right.withColumn("_own", key("_of")), "_own", "_rows", total).drop("_of", "_key", "_own", "_rows")


def _ratio() -> Column:
    """Pareto's ratio; null where the document is certain or has no words."""
    chance = F.col("_pull") * F.sqrt(F.col("_size"))
    odds = chance / (1 - chance)
    return F.when((F.col("_size") > 0) & (F.col("_pull") > 0) & (chance < 1), F.col("_luck") / (1 - F.col("_luck")) / odds)


def _certain() -> Column:
    return F.coalesce((F.col("_size") > 0) & (F.col("_pull") * F.sqrt(F.col("_size")) >= 1), F.lit(False))


def thresholds(base: DataFrame, mix: Mix) -> tuple[DataFrame, int, int]:
    """A row per source: _rows, source_size, target, _whole copies of each document, _pull (inclusion probability over the root of the size), _bar (the largest ratio that is taken); how many rows; and how many base has."""
    goals = targets(base, mix)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = table(goals.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-goals")
    n, total = goals.count(), base.count()

    # The pull at which expected words are the rest: sizes from the largest down are certain, until the pull fits the next.
    by_size = with_source(base.filter("_size > 0").groupBy("_source", "_size").agg(F.count("*").alias("n")), goals, n, total)
    down = Window.partitionBy("_source").orderBy(F.col("_size").desc())
    above = F.coalesce(F.sum(F.col("_size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("_size") * F.sqrt(F.col("_size")) * F.col("n")).over(down.rowsBetween(0, Window.unboundedFollowing))
    pulls = by_size.withColumn("_pull", (F.col("_rest") - above) / below)
    fits = (F.col("_pull") > 0) & (F.col("_pull") * F.sqrt(F.col("_size")) <= 1)
    pulls = pulls.groupBy("_source").agg(F.max_by(F.when(fits, F.col("_pull")), F.when(fits, F.col("_size"))).alias("_pull"))
    pulls = pulls.withColumnRenamed("_source", "_at")
    goals = goals.join(pulls, F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at")
    # No pull fits: nothing is left to take, or all documents are certain.
    nothing = F.col("_rest") < 0.5
    goals = goals.withColumn("_pull", F.when(nothing, F.lit(0.0)).otherwise(F.coalesce(F.col("_pull"), F.lit(float("inf")))))
    goals = table(goals, "mix-pulls")

    ranked = with_source(base.filter("_size > 0"), goals.select("_source", "_rows", "_rest", "_pull"), n, total).withColumn("_ratio", _ratio()).withColumn("_certain", _certain())
    ranked = ranked.filter(F.col("_certain") | F.col("_ratio").isNotNull())
    v = F.least(F.col("_ratio") / (1 + F.col("_ratio")), F.lit(1 - 2.0**-53))
    last, cut = None, 0
    while cut < CUTS:
        # Bins number the ratio's place from 0 to 1 in powers of BINS, so bins of a bin are its own exactly.
        cut += 1
        here = F.when(F.col("_certain"), F.lit(-1)).otherwise(F.floor(v * float(BINS**cut)))
        if last is None:
            bins = ranked.groupBy("_source", here.alias("_bin"), "_rest").agg(F.sum("_size").alias("words"), F.count("*").alias("n")).withColumn("_from", F.lit(0))
        else:
            inside = with_source(ranked.filter(~F.col("_certain")), last, n, total).filter(F.floor(v * float(BINS ** (cut - 1))) == F.col("_last"))
            bins = inside.groupBy("_source", here.alias("_bin"), "_rest").agg(F.sum("_size").alias("words"), F.count("*").alias("n"), F.max("_before").alias("_from"))
        up = Window.partitionBy("_source").orderBy("_bin")  # no more than BINS rows
        bins = bins.withColumn("_before", F.col("_from") + F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        last = bins.filter("_bin >= 0 and _before < _rest and _before + words >= _rest").select("_source", F.col("_bin").cast("long").alias("_last"), "_before", F.col("n").alias("_rows"))
        last = table(last, "mix-bins")
        if last.filter(F.col("_rows") > LAST_ROWS).isEmpty():
            break
    # Ratios of the bin in which the target is reached, in order; one more is taken while half of its words fit.
    there = with_source(ranked.filter(~F.col("_certain")), last, n, total).filter(F.floor(v * float(BINS**cut)) == F.col("_last"))
    there = there.groupBy("_source", "_last", "_before", "_rest", "_ratio").agg(F.sum("_size").alias("words"))
    order = Window.partitionBy("_source").orderBy("_ratio")
    so_far = F.col("_before") + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.when(so_far + F.col("words") / 2 <= F.col("_rest"), F.col("_ratio"))
    bars = there.withColumn("_taken", taken).groupBy("_source", "_last").agg(F.max("_taken").alias("_bar"))
    # None of that bin: the bar is the bin's lower edge, just missed.
    edge = F.col("_last") / F.lit(float(BINS**cut))
    bars = bars.select(F.col("_source").alias("_at"), F.coalesce(F.col("_bar"), F.when(F.col("_last") > 0, edge / (1 - edge) * (1 - 1e-12)).otherwise(F.lit(-1.0))).alias("_bar"))
    goals = goals.join(bars, F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at")
    return table(goals.select("_source", "_rows", "source_size", "target", "_whole", "_pull", F.coalesce("_bar", F.lit(float("inf"))).alias("_bar")), "mix-thresholds"), n, total


def copies() -> Column:
    """How often the mix takes a row that has _size, _luck and its source's thresholds."""
    extra = _certain() | F.coalesce(_ratio() <= F.col("_bar"), F.lit(False))
    return (F.col("_whole") + F.when(extra, 1).otherwise(0)).cast("long")


def mix_documents(df: DataFrame, id_col: str, text_col: str, source_col: str, mix: Mix | None = None) -> DataFrame:
    """One row per row of df: id_col, size, source_size, target, taken, copies.

    Null texts have size 0; sources are compared by code point, and null is a
    source of its own, the last.  A document of size 0 gets its source's whole
    copies and no luck.  Rows that repeat id and text share their luck and are
    taken or not together.  A source's taken words miss its target by half the
    words of one document (of all rows that repeat it) at most.  An empty table gives an empty table.
    """
    mix = mix or Mix()
    base = table(base_rows(df, id_col, text_col, source_col), "mix-base")
    goals, n, total = thresholds(base, mix)
    rows = with_source(base, goals, n, total).withColumn("_copies", copies())
    return rows.select(F.col(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def mixed_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, mix: Mix | None = None) -> DataFrame:
    """The rows of df as the mix takes them: each as often as its copies, with df's own columns."""
    mix = mix or Mix()
    base = table(base_rows(df, id_col, text_col, source_col), "mix-base")
    goals, n, total = thresholds(base, mix)
    inner = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), F.col(source_col).cast("string").alias("_source"), size_of(F.col(text_col)).alias("_size"), luck_of(id_col, text_col).alias("_luck"))
    rows = with_source(inner, goals, n, total).withColumn("_copies", copies()).filter("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return rows.select("_row.*")
