"""N-gram Jaccard self-join by chosen paths.

Documents are sets of word shingles; equal sets are one node from the start.
Min-hash coordinates sample tokens of a set so that two sets share one with
probability of their similarity.  A run splits all sets by two sampled tokens;
small buckets are compared at once, larger ones are split again by tokens that
hang on the path so far, and so on.  With two tokens a level, a pair at the
threshold survives a run to any depth with a fixed probability (CHANCE), and
runs repeat until the target recall.

Members of large buckets are also compared with a pivot.  A bucket whose members
are all connected by now tells nothing new and isn't split further, so large
groups of near copies end early.  Where few sets are outside a bucket's largest
connected part, these are compared with all of the bucket, tile by tile; so are
buckets of up to DIRECT sets, and those still larger after LEVELS splits.

What the buckets yield are candidates, joined to blocks by connected
components.  Within a block all pairs are then compared exactly, on whole
shingle sets; blocks beyond TILE sets are cut into tiles, and each pair of tiles
is a task's work of bounded size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, join_by_size, keep_rows, ready, slices, table
from .components import components

WORDS = 5
#: Similarity from which sets are linked, as a fraction of two integers.
NEAR = (4, 5)
COORDINATES = 128
RECALL = 0.9999
#: Sets of a bucket that are compared by brute force.
BUCKET = 128
#: Sets of a tile.
TILE = 384
#: Splits of a large bucket before its tiles are compared: what shares more than half its tokens with others wouldn't get smaller.
LEVELS = 4
#: Sets of a large bucket outside its largest connected part up to which they are compared with all of it at once.
OUTSIDERS = 1024
#: Sets of a bucket up to which it is compared by tiles without more splits, and sets of those tiles.
DIRECT, LINK_TILE = 6144, 2048
#: Agreement of coordinates from which two sets are candidates: over four standard deviations below the threshold.
AGREE = 84
#: The same for the first coordinates alone, over five standard deviations below.
FIRST, AGREE_FIRST = 32, 14
#: Rows of a large bucket that share one copy of its pivot, on average.
ROWS_PER_SALT = 1024

#: A pair at the threshold survives a level if one of two tokens is shared and the pair survives below it: q = 1 - (1 - 0.8 q)^2.
CHANCE = 0.9375


def runs_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - CHANCE)))


_random = np.random.default_rng(20_240_001)
_FACTORS = _random.integers(1, 2**63, COORDINATES, np.uint64) | np.uint64(1)
_TERMS = _random.integers(0, 2**63, COORDINATES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words of text, A-Z lowered; a text of fewer words is one run, one of none has none."""
    digest = xxhash.xxh3_64_intdigest
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter((digest(t) for t in tokens), np.uint64, len(tokens))
    n = max(1, len(w) - words + 1) if len(w) else 0
    h = np.zeros(n, np.uint64)
    for j in range(min(words, len(w))):
        h = (h ^ w[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(tokens: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for start in range(0, len(tokens), 1024):
        hashed = (tokens[start : start + 1024, None] * _FACTORS + _TERMS) >> np.uint64(32)
        np.minimum(out, hashed.min(0).astype(np.uint32), out=out)
    return out


def set_rows(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_id, _print (tells texts of one id apart), _set (null without words) and _sig of each row, in one scan."""
    ready(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("print")).alias("_key"), text.alias("text"))
    schema = pa.schema([("_key", pa.struct([("id", arrow_schema(df, id_col)[0].type), ("print", pa.int64())])), ("_set", pa.binary()), ("_sig", pa.binary())])

    def run(batches):
        for b in batches:
            for keys, part in slices(b):
                sets, sigs = [], []
                for text in part:
                    s = shingles(text, words)
                    sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield batch(schema, keys, sets, sigs)

    out = rows.mapInArrow(run, T.StructType([rows.schema["_key"], T.StructField("_set", T.BinaryType()), T.StructField("_sig", T.BinaryType())]))
    return out.select(F.col("_key.id").alias("_id"), F.col("_key.print").alias("_print"), "_set", "_sig")


def groups_of(batches, keys: int):
    """Lists of column arrays, one for each run of equal values in the first keys columns of sorted batches."""
    held: list = []

    def whole(parts):
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        first = tuple(c[0] for c in columns)
        if held and last != first:
            yield whole(held)
            held = []
        for start, stop in zip(cuts, cuts[1:]):
            if start:
                yield whole(held)
                held = []
            held.append(b.slice(start, stop - start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield whole(held)


def forest(n: int, pairs) -> list[int]:
    """Of each of n nodes, the least node that pairs connect it with."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        i, j = top(i), top(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]


def bucket_links(rows: DataFrame) -> DataFrame:
    """a, b: links that join the candidates of each small bucket; rows has path, set and sig."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        a, b = [], []
        for g in groups_of(batches, 1):
            n = g.num_rows
            if n < 2:
                continue
            sets = g.column(1).to_pylist()
            sigs = np.frombuffer(b"".join(g.column(2).to_pylist()), np.uint32).reshape(n, COORDINATES)
            if n == 2:
                tops = [0, 0 if (sigs[0] == sigs[1]).sum() >= AGREE else 1]
            else:
                pairs = ((i, i + 1 + int(j)) for i in range(n - 1) for j in np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(1) >= AGREE))
                tops = forest(n, pairs)
            for i, t in enumerate(tops):
                if t != i:
                    a.append(sets[i])
                    b.append(sets[t])
            if len(a) > 50_000:
                yield batch(schema, a, b)
                a, b = [], []
        yield batch(schema, a, b)

    dealt = rows.select("path", "set", "sig").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "a binary, b binary")


def agreement(x: Column, y: Column) -> Column:
    """How many coordinates two signatures share."""
    at = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
    return F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substring(x, i * 4 + 1, F.lit(4)) == F.substring(y, i * 4 + 1, F.lit(4)), 1).otherwise(0))


def step(path: Column, sig: Column, place: Column) -> Column:
    """The path below path of sets with sig's value at that place."""
    return F.xxhash64(path, place, F.substring(sig, place * 4 + 1, F.lit(4)))


def tile_links(rows: DataFrame, tile: int) -> DataFrame:
    """a, b: links of the candidates of each large bucket with other labels; rows has path, set, sig, label, n and outsider.

    Every row is in one tile of its bucket, and every outsider is compared
    with all tiles; what isn't an outsider has one label.
    """
    tiles = F.ceil(F.col("n") / tile).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int"))
    dealt = F.when(F.col("outsider"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("tile", F.explode(dealt)).select(F.xxhash64("path", "tile").alias("group"), "set", "sig", "label", "outsider", (F.col("own") == F.col("tile")).alias("here"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for g in groups_of(batches, 1):
            n = g.num_rows
            sets, labels = g.column(1).to_pylist(), np.unique(np.array(g.column(3).to_pylist(), object), return_inverse=True)[1]
            sigs = np.frombuffer(b"".join(g.column(2).to_pylist()), np.uint32).reshape(n, COORDINATES)
            here, pairs = np.flatnonzero(np.array(g.column(5).to_pylist(), bool)), []
            first, own_labels = np.ascontiguousarray(sigs[here, :FIRST]), labels[here]
            for i in np.flatnonzero(np.array(g.column(4).to_pylist(), bool)).tolist():
                other = here[((first == sigs[i, :FIRST]).sum(1) >= AGREE_FIRST) & (own_labels != labels[i])]
                if len(other):
                    pairs += [(i, int(j)) for j in other[(sigs[other] == sigs[i]).sum(1) >= AGREE]]
            tops = forest(n, pairs)
            chosen = [i for i in range(n) if tops[i] != i]
            yield batch(schema, [sets[i] for i in chosen], [sets[tops[i]] for i in chosen])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a binary, b binary")


def pivot_links(large: DataFrame) -> DataFrame:
    """a, b: links of each bucket's members with its pivot, the member of least hash; shares of a bucket's rows meet copies of it."""
    salts = F.ceil(F.col("k") / ROWS_PER_SALT).cast("int")
    pivots = large.groupBy("path").agg(F.min_by(F.struct("set", "sig"), F.xxhash64("set")).alias("v"), F.count("*").alias("k"))
    pivots = pivots.select(F.col("path").alias("p"), "v", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = large.withColumn("own", F.pmod(F.xxhash64("set"), F.ceil(F.col("n") / ROWS_PER_SALT)).cast("int"))
    compared = salted.join(pivots, (F.col("path") == F.col("p")) & (F.col("own") == F.col("salt")))
    return compared.filter((F.col("set") != F.col("v.set")) & (agreement(F.col("sig"), F.col("v.sig")) >= AGREE)).select(F.col("set").alias("a"), F.col("v.set").alias("b"))


def candidates(nodes: DataFrame, recall: float = RECALL, bucket: int = BUCKET, levels: int = LEVELS, outsiders: int = OUTSIDERS, direct: int = DIRECT, link_tile: int = LINK_TILE) -> DataFrame:
    """a, b: links whose components hold every pair of sets near enough, but for one in 1 / (1 - recall); nodes has set and sig."""
    runs = runs_for(recall)
    # Each run's first two tokens, drawn without replacement over runs.
    places = F.sequence(F.lit(0), F.lit(2 * runs - 1))
    rows = nodes.select("set", F.explode(F.transform(places, lambda i: F.struct(step(F.lit(0), F.col("sig"), i).alias("path")))).alias("s")).select("set", "s.path")
    counts = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("path").alias("p"), "n")
    total = 2 * runs * nodes.count()
    met = join_by_size(rows, "path", table(counts, "join-counts"), "p", "n", total).select("path", "set", "n")
    now = table(met.join(nodes.withColumnRenamed("set", "s"), F.col("set") == F.col("s")).select("path", "set", "sig", "n", F.col("set").alias("label")), "join-level")
    found = None
    for level in range(levels + 1):
        large = now.filter(F.col("n") > bucket)
        links = table(bucket_links(now.filter(F.col("n") <= bucket)).unionByName(pivot_links(large)), "join-links")
        found = links if found is None else found.unionByName(links)
        if large.isEmpty():
            break
        # What is connected already needs no more comparisons: buckets of one component are done.
        roots = components(found)
        labelled = large.drop("label").join(roots, F.col("set") == F.col("node"), "left").select("path", "set", "sig", "n", F.coalesce("root", "set").alias("label"))
        # A bucket's main label is its most frequent; the others' rows are its outsiders.
        labelled = table(labelled, "join-labelled")
        most = labelled.groupBy("path", "label").agg(F.count("*").alias("m")).groupBy(F.col("path").alias("p")).agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("_rows"))
        mixed = join_by_size(labelled, "path", table(most, "join-most"), "p", "_rows", labelled.count()).filter(F.col("m") < F.col("n")).drop("p", "_rows")
        mixed = table(mixed.withColumn("outsider", F.col("label") != F.col("main")), "join-mixed")
        few = (F.col("n") <= direct) | (F.col("n") - F.col("m") <= outsiders) | F.lit(level == levels)
        found = found.unionByName(table(tile_links(mixed.filter(few), link_tile), "join-links"))
        left = mixed.filter(~few)
        if level == levels or left.isEmpty():
            break
        below = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(step(F.col("path"), F.col("sig"), F.pmod(F.xxhash64(F.col("path"), k), F.lit(COORDINATES)).cast("int")).alias("path")))
        split = table(left.select("set", "sig", "label", F.explode(below).alias("s")).select("s.path", "set", "sig", "label").distinct(), "join-split")
        counts = split.groupBy("path").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("path").alias("p"), "n")
        now = table(join_by_size(split, "path", table(counts, "join-counts"), "p", "n", split.count()).select("path", "set", "sig", "n", "label"), "join-level")
    return found.distinct()


def near_pairs(own: list[np.ndarray], other: list[np.ndarray] | None):
    """(i, j) arrays of the near pairs: within own (i < j), or of own with other."""
    n, sets = len(own), own + (other or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1  # tokens of one set alone add to no intersection
    renumbered = np.cumsum(common) - 1
    column, row = renumbered[inverse][common[inverse]], np.repeat(np.arange(len(sets)), sizes)[common[inverse]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((n, len(sets) - n if other is not None else n), np.float32)
    width = 2048
    for start in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        shared += block[:n] @ (block[n:] if other is not None else block).T
    both = sizes[:n, None] + (sizes[None, n:] if other is not None else sizes[None, :])
    # shared / (both - shared) >= near, in integers.
    near = (NEAR[0] + NEAR[1]) * shared.astype(np.int64) >= NEAR[0] * both
    i, j = np.nonzero(np.triu(near, 1) if other is None else near)
    return i, j


def exact_links(df: DataFrame, id_col: str, text_col: str, words: int, members: DataFrame, tile: int = TILE) -> DataFrame:
    """set, top, links: per set and pair of tiles, how many rows of df its near sets have, and a set that they connect it with.

    members has _id, _print (one row of df per set), set, n (rows of that set), block and size (sets of the block).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_i"), text.alias("text")).withColumn("_p", F.xxhash64("text"))
    rows = rows.join(members, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_p") == F.col("_print"))).dropDuplicates(["set"])
    tiles = F.ceil(F.col("size") / tile).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int"))
    pair = lambda k: F.struct(F.least("own", k).alias("lo"), F.greatest("own", k).alias("hi"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair)))
    rows = rows.withColumn("group", F.xxhash64("block", "pair.lo", "pair.hi")).withColumn("second", F.col("own") > F.col("pair.lo"))
    rows = rows.select("group", "block", "second", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "set", "n", "text")
    schema = pa.schema([("set", pa.binary()), ("top", pa.binary()), ("links", pa.int64())])

    def run(batches):
        for g in groups_of(batches, 1):
            second = np.array(g.column(2).to_pylist(), bool)
            order = np.argsort(second, kind="stable").tolist()
            g = g.take(pa.array(order))
            sets, rows_of = g.column(5).to_pylist(), np.array(g.column(6).to_pylist(), np.int64)
            tokens = [shingles(t, words) for t in g.column(7).to_pylist()]
            first = len(order) - int(second.sum())
            across = g.column(3)[0].as_py() != g.column(4)[0].as_py()
            if (across and first in (0, len(order))) or len(order) < 2:
                continue
            i, j = near_pairs(tokens[:first], tokens[first:] if across else None)
            j = j + first * across
            links = np.bincount(i, rows_of[j], len(order)) + np.bincount(j, rows_of[i], len(order))
            tops = forest(len(order), zip(i.tolist(), j.tolist()))
            chosen = np.flatnonzero(links).tolist()
            yield batch(schema, [sets[k] for k in chosen], [sets[tops[k]] for k in chosen], links[chosen].astype(np.int64))

    dealt = rows.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "set binary, top binary, links long")


def near_rows(df: DataFrame, id_col: str, text_col: str, *, words: int = WORDS, tile: int = TILE, **options) -> DataFrame:
    """One row per row of df: _id, _print (xxhash64 of the text), class_id, n_links, kept.

    Rows are linked if their sets of runs of five words are similar by 0.8 or
    more (Jaccard); a class is what links connect, class_id its least id that
    isn't null, n_links the number of rows a row is linked with.  kept marks the
    row of that id.  A text of one to four words is one run; texts without
    words (null, empty, blank) have no links and are a class each.  Rows that
    repeat id and text are linked with each other and kept alike; in a class of
    null ids the row of the least hash of its text is kept.
    """
    rows = table(set_rows(df, id_col, text_col, words), "join-sets")
    keeper = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_print").alias("print"))
    sets = table(rows.filter("_set is not null").groupBy(F.col("_set").alias("set")).agg(F.min("_sig").alias("sig"), F.count("*").alias("n"), F.min(keeper).alias("keeper")), "join-nodes")
    blocks = table(components(candidates(sets.select("set", "sig"), **options)), "join-blocks")
    sized = blocks.join(blocks.groupBy("root").agg(F.count("*").alias("size")).withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
    members = sized.join(sets, F.col("node") == F.col("set")).select(F.col("keeper.id").alias("_id"), F.col("keeper.print").alias("_print"), "set", "n", F.col("root").alias("block"), "size")
    linked = table(exact_links(df, id_col, text_col, words, members, tile), "join-exact")
    degrees = linked.groupBy("set").agg(F.sum("links").alias("links")).withColumnRenamed("set", "s")
    roots = components(linked.filter("set <> top"), "set", "top")
    placed = sets.select("set", "n", "keeper").join(degrees, F.col("set") == F.col("s"), "left").join(roots, F.col("set") == F.col("node"), "left")
    placed = table(placed.select("set", "n", "keeper", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set").alias("root")), "join-placed")
    classes = placed.groupBy("root").agg(F.min("keeper").alias("first"), F.count("*").alias("k")).withColumnRenamed("root", "r")
    answers = join_by_size(placed, "root", table(classes, "join-classes"), "r", "k", placed.count())
    answers = table(answers.select(F.col("set").alias("s"), (F.col("n") - 1 + F.col("links")).alias("links"), "first", "n"), "join-answers")
    rows = rows.drop("_sig")
    out = join_by_size(rows.filter("_set is not null"), "_set", answers, "s", "n", rows.count()).drop("n")
    out = out.unionByName(rows.filter("_set is null"), allowMissingColumns=True)  # texts without words have no class to join
    alone = F.col("s").isNull()
    kept = alone | (F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_print") == F.col("first.print")))
    return out.select(
        "_id",
        "_print",
        F.when(alone, F.col("_id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        kept.alias("kept"),
    )


def near_classes(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """near_rows() with the ids under their own name: id_col, class_id, n_links, kept."""
    return near_rows(df, id_col, text_col, **options).select(F.col("_id").alias(id_col), "class_id", "n_links", "kept")


def one_of_each_class(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of df that near_rows() keeps, with df's own columns."""
    return keep_rows(df, id_col, text_col, near_rows(df, id_col, text_col, **options))
