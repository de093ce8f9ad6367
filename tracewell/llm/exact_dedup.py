"""Exact deduplication against immutable snapshots, screened by static filters.

Texts are equal when identical after lower-casing A-Z.  Every batch of rows is
grouped by digest on its own (its own duplicates meet there, pre-aggregated),
and the groups become a snapshot: exact buckets by digest, and per bucket a
binary fuse filter.  A later batch's digests go through the filters of all
earlier snapshots; only positives are joined with the exact buckets.  Rows that
share a digest are then compared byte by byte with one text of their class;
hot classes are split by salts for that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, keep_rows, ready, table

BATCHES = 3
#: Keys of a filter at most, on average: a filter takes about nine bits a key.
KEYS_PER_FILTER = 500_000
#: Rows of a class that are compared by one task's share, on average.
ROWS_PER_SALT = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class BinaryFuseFilter:
    """A static three-wise binary fuse filter of 8-bit fingerprints over distinct 64-bit keys.

    No false negatives; about one false positive in 256.
    """

    TRIES = 100

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
        x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, in neighbouring segments, and its fingerprint."""
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        slots = np.stack([first, (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask), (first + np.uint64(2 * segment)) ^ (h & mask)])
        return slots.astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 2 ** int(math.log(max(n, 2)) / math.log(3.33) + 2.25)
        capacity = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))))
        segments = max(1, math.ceil(capacity / segment) - 2)
        size = (segments + 2) * segment
        for seed in range(cls.TRIES):
            slots, prints = cls._slots(cls._hash(keys, seed), segment, segments)
            count = np.bincount(slots.ravel(), minlength=size)
            mixed = np.zeros(size, np.int64)
            for row in slots:
                np.bitwise_xor.at(mixed, row, np.arange(n))
            peeled, alone, done = [], np.flatnonzero(count == 1), 0
            while len(alone):
                found, at = np.unique(mixed[alone], return_index=True)
                peeled.append((found, alone[at]))
                done += len(found)
                for row in slots:
                    np.subtract.at(count, row[found], 1)
                    np.bitwise_xor.at(mixed, row[found], found)
                touched = np.unique(slots[:, found])
                alone = touched[count[touched] == 1]
            if done == n:
                out = np.zeros(size, np.uint8)
                for found, at in reversed(peeled):
                    out[at] = 0
                    a, b, c = slots[:, found]
                    out[at] = prints[found] ^ out[a] ^ out[b] ^ out[c]
                return cls(seed, segment, segments, out)
        raise ValueError("the filter couldn't be built")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(self._hash(keys.astype(np.uint64), self.seed), self.segment, self.segments)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == prints


def keys_of(digests: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(d) for d in digests.to_pylist()), np.uint64, len(digests))


def sha256(text: Column) -> Column:
    """The digest of a normalised text."""
    return F.unhex(F.sha2(text, 256))


def digest_rows(df: DataFrame, id_col: str, text_col: str, batches: int, digest=sha256) -> DataFrame:
    """_id, _print (tells texts of one id apart), _batch and _digest of each row, in one scan."""
    ready(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_print"), digest(normal(text)).alias("_digest"))
    return out.withColumn("_batch", F.pmod(F.xxhash64("_id", "_print"), F.lit(batches)).cast("int"))


def snapshots(groups: DataFrame) -> DataFrame:
    """Per batch and bucket of digests, its binary fuse filter."""
    schema = pa.schema([("_batch", pa.int32()), ("_bucket", pa.int32()), ("seed", pa.int32()), ("segment", pa.int64()), ("segments", pa.int64()), ("prints", pa.binary())])

    def build(t: pa.Table) -> pa.Table:
        made = BinaryFuseFilter.build(keys_of(t["_digest"]))
        return pa.table([[x] for x in (t["_batch"][0].as_py(), t["_bucket"][0].as_py(), made.seed, made.segment, made.segments, made.prints.tobytes())], schema=schema)

    return groups.select("_batch", "_bucket", "_digest").groupBy("_batch", "_bucket").applyInArrow(build, "_batch int, _bucket int, seed int, segment long, segments long, prints binary")


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """_digest, _batch and _hit of the groups that the filter of an earlier batch lets through."""
    schema = pa.schema([("_digest", pa.binary()), ("_batch", pa.int32()), ("_hit", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        digests, batches, keys = left["_digest"], left["_batch"].to_numpy(), keys_of(left["_digest"])
        found = []
        for row in right.to_pylist():
            later = np.flatnonzero(batches > row["_batch"])
            own = BinaryFuseFilter(row["seed"], row["segment"], row["segments"], np.frombuffer(row["prints"], np.uint8))
            hits = later[own.contains(keys[later])] if len(later) else later
            found.append(pa.table([digests.take(pa.array(hits)), pa.array(batches[hits], pa.int32()), pa.array(np.full(len(hits), row["_batch"], np.int32))], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    left = groups.select("_bucket", "_digest", "_batch").groupBy("_bucket")
    return left.cogroup(filters.groupBy("_bucket")).applyInArrow(run, "_digest binary, _batch int, _hit int")


def placed_rows(df: DataFrame, id_col: str, text_col: str, batches: int, digest) -> DataFrame:
    """_id, _print, _digest of each row of df, with _keep, _first (the largest _print of rows of that id) and _n (rows) of its class."""
    spark = df.sparkSession
    rows = table(digest_rows(df, id_col, text_col, batches, digest), "dedup-rows")
    groups = table(rows.groupBy("_batch", "_digest").agg(F.max(F.struct("_id", "_print")).alias("_top"), F.count("*").alias("_n")), "dedup-groups")
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups.count() / KEYS_PER_FILTER))
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64("_digest"), F.lit(buckets)).cast("int"))
    filters = table(snapshots(groups), "dedup-filters")
    positives = table(screen(groups, filters), "dedup-positives")

    # The exact join tells true positives from false ones; a group's origin is the first batch that has its digest.
    exact = groups.select(F.col("_digest").alias("_d"), F.col("_batch").alias("_b"))
    origins = positives.join(exact, (F.col("_digest") == F.col("_d")) & (F.col("_hit") == F.col("_b"))).groupBy("_digest", "_batch").agg(F.min("_hit").alias("_origin"))
    origins = origins.select(F.col("_digest").alias("_d"), F.col("_batch").alias("_b"), "_origin")
    placed = groups.join(origins, (F.col("_digest") == F.col("_d")) & (F.col("_batch") == F.col("_b")), "left").withColumn("_origin", F.coalesce("_origin", "_batch"))
    classes = placed.groupBy("_digest", "_origin").agg(F.max("_top").alias("_top"), F.sum("_n").alias("_n"))
    classes = table(classes.select(F.col("_digest").alias("_d"), F.col("_top._id").alias("_keep"), F.col("_top._print").alias("_first"), "_n"), "dedup-classes")
    met = join_by_size(rows, "_digest", classes, "_d", "_n", rows.count())
    placed = table(met.select("_id", "_print", "_digest", "_keep", "_first", "_n"), "dedup-placed")

    apart = table(byte_check(df, id_col, text_col, placed), "dedup-apart")
    if not apart.isEmpty():
        placed = tell_apart(placed, apart)
    return placed


def dedup_exact(df: DataFrame, id_col: str, text_col: str, *, batches: int = BATCHES, digest=sha256) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id of the equal texts; group_size counts rows.  Null
    texts are empty.  Null ids count as smaller than all others; a group of
    null ids only keeps null.  Rows that repeat an id are the same document:
    they are counted, and kept alike.  An empty table gives an empty table.

    batches: rows fall into that many batches by a hash of id and text; each
    is a snapshot for those after it.  digest: a column (binary) of the
    normalised text; rows of one digest whose bytes differ are told apart.
    """
    return placed_rows(df, id_col, text_col, batches, digest).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def one_of_each_text(df: DataFrame, id_col: str, text_col: str, *, batches: int = BATCHES) -> DataFrame:
    """One row of df for each text, with df's own columns: of the largest id; of rows that share it (or have none), that of the largest hash of its text."""
    rows = placed_rows(df, id_col, text_col, batches, sha256)
    return keep_rows(df, id_col, text_col, rows.withColumn("kept", F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_print") == F.col("_first"))))


def normal(column: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(column, _UPPER, _LOWER)


def byte_check(df: DataFrame, id_col: str, text_col: str, placed: DataFrame) -> DataFrame:
    """Rows whose text differs from the text of their class: _id, _print, _digest, _text (normalised)."""
    members = placed.filter("_n > 1").select(F.col("_id").alias("_m"), F.col("_print").alias("_p"), "_digest", "_keep", "_first", "_n").distinct()
    read = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_print", F.xxhash64("_text"))
    own = table(read.join(members, F.col("_id").eqNullSafe(F.col("_m")) & (F.col("_print") == F.col("_p"))).drop("_m", "_p"), "dedup-members")
    salts = F.ceil(F.col("_n") / ROWS_PER_SALT).cast("int")
    held = own.filter(F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_print") == F.col("_first"))).groupBy("_digest").agg(F.min("_text").alias("_held"), F.max("_n").alias("_n"))
    held = held.select(F.col("_digest").alias("_d"), "_held", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_s"))
    own = own.withColumn("_salt", F.pmod(F.xxhash64("_id", "_print"), salts).cast("int"))
    same = (F.col("_text") == F.col("_held")) | (normal(F.col("_text")) == normal(F.col("_held")))
    met = own.join(held, (F.col("_digest") == F.col("_d")) & (F.col("_salt") == F.col("_s")))
    return met.filter(~same).select("_id", "_print", "_digest", normal(F.col("_text")).alias("_text")).distinct()


def tell_apart(placed: DataFrame, apart: DataFrame) -> DataFrame:
    """placed with classes by digest and text, where texts of one digest differ."""
    right = apart.select(F.col("_id").alias("_a"), F.col("_print").alias("_b"), F.col("_digest").alias("_d"), "_text")
    rows = placed.join(right, F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_print") == F.col("_b")) & (F.col("_digest") == F.col("_d")), "left").select("_id", "_print", "_digest", "_text")
    classes = rows.groupBy("_digest", "_text").agg(F.max(F.struct("_id", "_print")).alias("_top"), F.count("*").alias("_n"))
    classes = classes.select(F.col("_digest").alias("_d"), F.col("_text").alias("_t"), F.col("_top._id").alias("_keep"), F.col("_top._print").alias("_first"), "_n")
    joined = rows.join(classes, (F.col("_digest") == F.col("_d")) & F.col("_text").eqNullSafe(F.col("_t")))
    return joined.select("_id", "_print", "_digest", "_keep", "_first", "_n")
