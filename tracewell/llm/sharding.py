"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Each source's rows are ranked in a seeded shuffle; row r of a source of n rows
stands at (2r + 1) / 2n, and all rows sorted by that are an interleaving in which
every stretch has each source in proportion.  Cut into stretches of equal length
they are the shards: counts differ by one at most, and a source's rows in a shard
miss their share by one at most at either end.

No sort has a source, or everything, in one task.  Ranks are places in bins: the
shuffle's key is uniform, so a source's rows fall into bins of about `BIN_ROWS`;
bins are counted, each starts where those before it end, and rows are numbered
inside their bin.  Fractional ranks are uniform too, so the sort over all rows is
done the same way.  Rows that repeat one another are counted first, in groups of
`REPEATS` at most, and become rows again once they are ranked.  Only light rows
(no texts) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ready, table

SHARDS, SEED = 16, 1
#: Rows of a bin, about; more where there would be over MOST_BINS bins, whose starts are summed up in one sort.
BIN_ROWS, MOST_BINS = 2_000, 5_000_000
#: Equal rows that are counted as one at most: a power of two.
REPEATS = 8192
#: Sources up to which a row for each is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000

_DIGITS = 12


def shuffled(id_col: str, seed: int) -> Column:
    """The key of the seeded shuffle, from the id alone: hexadecimal digits, uniform."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _light(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: Column) -> DataFrame:
    """Groups of equal rows: _id, _source, _key, _size, _crc, _print, _salt and how many, n."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("_id"), source.alias("_source"), shuffled(id_col, seed).alias("_key"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"), F.xxhash64(text).alias("_print"), F.floor(row / REPEATS).alias("_salt"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _starts(counts: DataFrame, name: str, by: list[str]) -> DataFrame:
    """For each bin, how many rows stand before it (among those of the same by), as name."""
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    return counts.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def _ranked(light: DataFrame) -> tuple[DataFrame, int]:
    """A row for each row of light's groups, with _copy, _rank in its source and _rows of it; and how many."""
    sources = table(light.groupBy("_source").agg(F.sum("n").alias("_rows")), "shard-sources")
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    right = F.broadcast(sources) if n <= BROADCAST_ROWS else sources
    bin_rows = max(BIN_ROWS, total // MOST_BINS)
    first = F.conv(F.substring("_key", 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))
    rows = light.join(right, "_source").withColumn("_bin", F.floor(first * F.ceil(F.col("_rows") / bin_rows)))
    starts = _starts(rows.groupBy("_source", "_bin").agg(F.sum("n").alias("n")), "_start", ["_source"])
    before = Window.partitionBy("_source", "_bin").orderBy("_key", F.col("_id").asc_nulls_first(), "_size", "_crc", "_print", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts.hint("shuffle_hash"), ["_source", "_bin"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.withColumn("_rank", F.col("_start") + F.col("_inside") + F.col("_copy")).drop("_bin", "_start", "_inside", "n"), total


def _placed(light: DataFrame, shards: int) -> DataFrame:
    """_ranked() with _place in the interleaving, _shard and _slot."""
    ranked, total = _ranked(table(light, "shard-rows"))
    at = (2 * F.col("_rank") + 1) / (2 * F.col("_rows"))
    ranked = ranked.withColumn("_at", at).withColumn("_bin", F.floor(F.col("_at") * -(-total // max(BIN_ROWS, total // MOST_BINS))))
    ranked = table(ranked, "shard-ranks")
    starts = _starts(ranked.groupBy("_bin").agg(F.count("*").alias("n")), "_start", [])
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("_at", "_source")) - 1
    placed = ranked.withColumn("_inside", inside).join(starts.hint("shuffle_hash"), "_bin").withColumn("_place", F.col("_start") + F.col("_inside"))
    shard = F.expr(f"_place * {shards} div {max(1, total)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard.cast("int")).withColumn("_slot", (F.col("_place") - first).cast("long"))


def shard_documents(df: DataFrame, id_col: str, text_col: str, source_col: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of df: id_col, size, text_crc32, law, shard, slot, grown_shard, place.

    size is the text's UTF-8 bytes and one more; a null text is empty.  The law
    is `rows`: shards' counts are at most one apart, so grown_shard is null.
    Sources are compared as text, and null is a source of its own, the first of
    equal fractional ranks.  The shuffle goes by the seed and the id (null as the
    empty text); rows of one id by size, crc32 and hash of their text.  Equal
    texts are rows like others: copies spread over the shards.  Equal rows get
    places next to each other in their source, in any order.  With fewer rows
    than shards some shards are empty.  An empty table gives an empty table.
    """
    if clash := {id_col} & {"size", "text_crc32", "law", "shard", "slot", "grown_shard", "place"}:
        raise ValueError(f"the id column can't be called {clash.pop()}: the result has a column of that name")
    ready(df)
    placed = _placed(_light(df, id_col, text_col, source_col, seed, F.monotonically_increasing_id()), shards)
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_place").cast("long").alias("place"),
    )


def write_shards(df: DataFrame, id_col: str, text_col: str, source_col: str, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes df's rows, with their own columns, to folder/shard=N in files of consecutive slots; a column slot is added.

    Rows are numbered first, so that those that repeat one another get a place each.
    """
    if clash := set(df.columns) & {"shard", "slot"}:
        raise ValueError(f"the column {clash.pop()} would be there twice")
    ready(df)
    left = numbered(df)
    light = _light(left, id_col, text_col, source_col, seed, F.col("_row"))
    placed = _placed(light, shards).select("_id", "_source", "_print", "_salt", F.col("_copy").alias("_k"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = left.select(F.struct(*[left[c] for c in df.columns]).alias("_own"), F.col(id_col).alias("_i"), source.alias("_s"), F.xxhash64(text).alias("_p"), F.floor(F.col("_row") / REPEATS).alias("_g"), "_row")
    number = F.row_number().over(Window.partitionBy("_i", "_s", "_p", "_g").orderBy("_row")) - 1  # REPEATS rows at most
    rows = rows.withColumn("_n", number)
    joined = rows.join(placed, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_source")) & (F.col("_p") == F.col("_print")) & (F.col("_g") == F.col("_salt")) & (F.col("_n") == F.col("_k")))
    joined.select("_own.*", "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
