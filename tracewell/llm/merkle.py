"""Document fingerprints: Merkle trees over paragraphs and sections.

A text's bytes are cut into leaves where a rolling hash says so (some 16 bytes
each, 64 at most) and at every line end; leaves form paragraphs (lines), paragraphs form
sections (which end at a blank line, or where a paragraph's digest says so),
sections form the root.  Cuts hang on the bytes around them alone, so an edit
changes the branches it touches and no others.  Equal roots mean equal texts;
two trees are compared from the top, descending only into branches that differ,
which finds both where they differ and how much they share.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, ready, table

LEAF_BITS = 4  # leaves of 16 bytes on average
LEAF_MOST = 64
WINDOW = 8  # bytes that decide on a cut
SECTION = 8  # paragraphs of a section on average
KEPT = 16  # bytes of a digest by which nodes are compared
BLOCK = 1 << 20  # bytes that are looked at for cuts at once
FEW = 512  # digests that are counted without sorting
SORTED = 1 << 17  # digests that are sorted at once

_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4, person=b"leaf cuts").digest() for i in range(256)), "<u4")


class Level(NamedTuple):
    """All nodes of one level in order: the first half of a branch's digest or all of a leaf's, where each begins in the text, its first child below."""

    digests: np.ndarray
    starts: np.ndarray  # one more than nodes: the last is the text's end
    first: np.ndarray | None  # the same; None for leaves


@dataclass
class Tree:
    """A root's digest and size, and its levels: sections, paragraphs, leaves; equal digests are equal trees."""

    digest: bytes
    size: int
    levels: list[Level] = field(compare=False)


class _Nodes:
    """A level that grows."""

    def __init__(self):
        self.digests, self.starts, self.first = bytearray(), array("I"), array("I")

    def add(self, digest: bytes, start: int, first: int = 0):
        self.digests += digest[:KEPT]
        self.starts.append(start)
        self.first.append(first)

    def level(self, size: int, children: int | None) -> Level:
        return Level(np.frombuffer(bytes(self.digests), f"S{KEPT}"), _closed(self.starts, size), None if children is None else _closed(self.first, children))


def _closed(numbers: array, last: int) -> np.ndarray:
    return np.append(np.frombuffer(numbers, np.uint32), np.uint32(last)) if len(numbers) else np.array([last], np.uint32)


def _digest(level: bytes, count: int, below) -> bytes:
    """The digest of a branch of count children, whose digests lie below, one after another."""
    own = hashlib.sha256(level + count.to_bytes(4, "big"))
    own.update(below)
    return own.digest()


def cuts(data: bytes):
    """Where leaves end, a list for each block of data."""
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, len(raw), BLOCK):
        before = max(0, start - WINDOW + 1)  # the first bytes of a block hang on the last of the one before
        part = raw[before : start + BLOCK]
        gear = _GEAR[part]
        rolled = gear.copy()
        for j in range(1, min(WINDOW, len(part))):
            rolled[j:] += gear[:-j] << np.uint32(j)
        cut = ((rolled >> np.uint32(32 - LEAF_BITS)) == 0) | (part == 10)
        if start + BLOCK >= len(raw):
            cut[-1] = True
        yield (np.flatnonzero(cut[start - before :]) + (start + 1)).tolist()


def tree(data: bytes) -> Tree:
    """The tree of data, held in arrays: some 20 bytes a leaf and 24 a branch."""
    hashed, size = hashlib.blake2b, len(data)
    leaves, paragraphs, sections = _Nodes(), _Nodes(), _Nodes()
    add = leaves.add
    start = leaf = paragraph = 0  # of the open leaf its byte; of the open paragraph and section their first children
    inside, below = bytearray(), bytearray()  # whole digests: of the open section's paragraphs, of all sections
    line = block = 0  # where the open paragraph and section begin

    def close_section():
        count = len(paragraphs.starts) - paragraph
        digest = _digest(b"section", count, inside)
        sections.add(digest, block, paragraph)
        below.extend(digest)
        inside.clear()

    for ends in cuts(data):
        for end in ends:
            while end - start > LEAF_MOST:
                add(hashed(data[start : start + LEAF_MOST], digest_size=KEPT).digest(), start)
                start += LEAF_MOST
            piece = data[start:end]
            add(hashed(piece, digest_size=KEPT).digest(), start)
            start = end
            if piece[-1] != 10 and end != size:
                continue
            count = len(leaves.starts) - leaf
            with memoryview(leaves.digests) as view:
                digest = _digest(b"paragraph", count, view[KEPT * leaf :])
            paragraphs.add(digest, line, leaf)
            inside += digest
            leaf, line = len(leaves.starts), end
            if (count == 1 and not piece.strip()) or digest[0] % SECTION == 0:
                close_section()
                paragraph, block = len(paragraphs.starts), end
    if inside:
        close_section()
    root = _digest(b"root", len(sections.starts), below)
    levels = [sections.level(size, len(paragraphs.starts)), paragraphs.level(size, len(leaves.starts)), leaves.level(size, None)]
    return Tree(root, size, levels)


def _left_over(own: list, other: list) -> np.ndarray:
    there = Counter(other)
    out = np.ones(len(own), bool)
    for i, x in enumerate(own):
        n = there.get(x)
        if n:
            there[x] = n - 1
            out[i] = False
    return out


def unmatched(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of left have no partner of the same digest in right, and the other way; each has one partner at most.

    Few digests are counted one by one; many are compared by shares of their values, so that sorting needs little room.
    """
    if len(left) + len(right) <= FEW:
        a, b = left.tolist(), right.tolist()
        return _left_over(a, b), _left_over(b, a)
    alone = np.ones(len(left), bool), np.ones(len(right), bool)
    shares = 1 + (len(left) + len(right)) // SORTED
    if not len(left) or not len(right):
        return alone
    share = [x.view(np.uint8).reshape(-1, KEPT)[:, :2].copy().view(np.uint16)[:, 0] % shares for x in (left, right)] if shares > 1 else None
    for k in range(shares):
        at = [np.flatnonzero(s == k) for s in share] if share else [np.arange(len(x)) for x in (left, right)]
        kinds, inverse = np.unique(np.concatenate([left[at[0]], right[at[1]]]), return_inverse=True)
        sides = inverse[: len(at[0])], inverse[len(at[0]) :]
        both = np.minimum(*(np.bincount(x, minlength=len(kinds)) for x in sides))
        for x, where, out in zip(sides, at, alone):
            order = np.argsort(x, kind="stable")
            counts = np.bincount(x, minlength=len(kinds))
            place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)  # among equal ones
            out[where[order]] = place >= both[x[order]]
    return alone


def shared_bytes(a: Tree, b: Tree) -> int:
    """Bytes of a under branches that b has too, each of b's counted once."""
    if a.digest == b.digest:
        return a.size
    total, left, right = 0, np.arange(len(a.levels[0].digests)), np.arange(len(b.levels[0].digests))
    for own, other in zip(a.levels, b.levels):
        rest, missing = unmatched(own.digests[left], other.digests[right])
        met = left[~rest]
        total += int((own.starts[met + 1] - own.starts[met]).sum(dtype=np.int64))
        if own.first is None:
            break
        left, right = _below(own.first, left[rest]), _below(other.first, right[missing])
    return total


def _below(first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The children of nodes, in order."""
    begin = first[nodes].astype(np.int64)
    counts = first[nodes + 1] - begin
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def likeness(a: Tree, b: Tree) -> float:
    """Twice the shared bytes over all bytes of both: 1 for equal trees, two empty ones included."""
    return 1.0 if a.digest == b.digest else min(1.0, 2 * shared_bytes(a, b) / (a.size + b.size))


def first_difference(a: Tree, b: Tree) -> int | None:
    """Where in a the first leaf begins that differs from b's at its place, in bytes; None for equal trees."""
    if a.digest == b.digest:
        return None
    at, end, other, last = 0, len(a.levels[0].digests), 0, len(b.levels[0].digests)
    for own, theirs in zip(a.levels, b.levels):
        both = min(end - at, last - other)
        differ = own.digests[at : at + both] != theirs.digests[other : other + both]
        i = int(differ.argmax()) if differ.any() else both
        if own.first is None or i == both:
            return int(own.starts[at + i])
        at, end, other, last = int(own.first[at + i]), int(own.first[at + i + 1]), int(theirs.first[other + i]), int(theirs.first[other + i + 1])
    return None


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first code points of following, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_FIELDS = [
    ("n_chars", pa.int64(), T.LongType()),
    ("edited_sha256", pa.string(), T.StringType()),
    ("fingerprint", pa.string(), T.StringType()),
    ("edited_fingerprint", pa.string(), T.StringType()),
    ("near_edited", pa.float64(), T.DoubleType()),
    ("near_next", pa.float64(), T.DoubleType()),
    ("edit_byte", pa.int64(), T.LongType()),
]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def compare(text: str, own: Tree, following: str, after: Tree) -> tuple:
    """The values of _FIELDS."""
    changed = _bytes(edited(text, following))
    other = tree(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), own.digest.hex(), other.digest.hex(), likeness(own, other), likeness(own, after), first_difference(own, other)


def fingerprint_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of df: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_byte.

    The next document is the next by id (and by a hash of the text among rows
    that repeat an id), after the last the first; null ids come first.  A null
    text is empty; edit_byte is where the edited text's tree first differs, null
    where it doesn't.  A single row is its own next.  An empty table gives an
    empty table.  An id column of the name of a result raises ValueError.
    Trees are arrays, and a task holds three of them and two texts at a time.

    Rows are dealt by ranges of ids and walked in order.  A range's last row
    waits for the first of the range after it: these few rows, two a range,
    meet in a second small step.
    """
    spark = ready(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_print"))
    order = [F.col("_id").asc_nulls_first(), F.col("_print")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    own_type = arrow_schema(df, id_col, *[(n, k) for n, k, _ in _FIELDS])[0].type  # raises if the id has the name of a result
    kinds = [pa.field("_id", own_type), *[pa.field(n, k) for n, k, _ in _FIELDS], ("_part", pa.int32()), ("_seq", pa.int32()), ("_text", pa.large_string())]
    schema = pa.schema(kinds)
    spark_schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), *[T.StructField(n, k) for n, _, k in _FIELDS], T.StructField("_part", T.IntegerType()), T.StructField("_seq", T.IntegerType()), T.StructField("_text", T.StringType())])
    empty = (None,) * len(_FIELDS)

    def out(ids: list, values: list[tuple], tails: list[tuple]) -> pa.RecordBatch:
        columns = [pa.concat_arrays(ids) if ids else pa.array([], schema[0].type)]
        columns += [pa.array([v[i] for v in values], schema[1 + i].type) for i in range(len(_FIELDS))]
        columns += [pa.array([t[i] for t in tails], schema[1 + len(_FIELDS) + i].type) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def walk(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            ids, values, tails = [], [], []
            for i, value in enumerate(b.column(1)):
                text = value.as_py()
                own = tree(_bytes(text))
                if held is None:  # the range's first row, in case it is another's next
                    ids.append(b.column(0).slice(i, 1))
                    values.append(empty)
                    tails.append((part, 0, text))
                else:
                    ids.append(held[0])
                    values.append(compare(held[1], held[2], text, own))
                    tails.append((part, None, None))
                held = b.column(0).slice(i, 1), text, own
            if ids:
                yield out(ids, values, tails)
        if held is not None:
            yield out([held[0]], [empty], [(part, 1, held[1])])

    walked = table(rows.mapInArrow(walk, spark_schema), "merkle")
    names = [n for n, _, _ in _FIELDS]

    # Rows that wait: each range's last, with the text of the first of the next range that has rows.
    edges = walked.filter("_seq is not null").select("_id", "_part", "_seq", "_text")
    parts = sorted(r[0] for r in edges.filter("_seq = 1").select("_part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_of int, _after int")
    firsts = edges.filter("_seq = 0").select(F.col("_part").alias("_at"), F.col("_text").alias("_next"))
    last = edges.filter("_seq = 1").join(F.broadcast(after), F.col("_part") == F.col("_of"))
    waiting = last.join(firsts.hint("shuffle_hash"), F.col("_after") == F.col("_at")).select("_id", "_text", "_next")
    done_schema = T.StructType(spark_schema.fields[: 1 + len(_FIELDS)])
    arrow_done = pa.schema(kinds[: 1 + len(_FIELDS)])

    def finish(batches):
        for b in batches:
            pairs = ((t.as_py(), n.as_py()) for t, n in zip(b.column(1), b.column(2)))
            values = [compare(t, tree(_bytes(t)), n, tree(_bytes(n))) for t, n in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([v[i] for v in values], arrow_done[1 + i].type) for i in range(len(_FIELDS))]], schema=arrow_done)

    finished = walked.filter("_seq is null").select("_id", *names).unionByName(waiting.mapInArrow(finish, done_schema))
    return finished.select(F.col("_id").alias(id_col), *names)
