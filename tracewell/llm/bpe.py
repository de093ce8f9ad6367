"""Byte-level BPE in two tiers: a minimal perfect hash, then a heap of merges.

Whole pre-tokens that are in the vocabulary resolve through a minimal perfect
hash over the vocabulary's byte strings (levels of bit arrays; a key's place is
the number of set bits before its own).  The rest are merged bottom up: a
linked list of byte positions and a heap of candidate pairs by rank.

Each batch's distinct pre-tokens are resolved once; whole vocabularies are
fixed files, read on each worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_texts

_SEEDS = 8  # how often the hash of all keys is drawn anew before giving up
_MIX = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a ranks file, by rank; ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * _MIX % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Places 0 to n-1 for n distinct byte strings, and a check that tells others from them."""

    def __init__(self, keys: list[bytes], gamma: float = 2.0):
        self.keys = keys
        for self.seed in range(_SEEDS):
            hashes = self.hashes(keys)
            if len(np.unique(hashes)) == len(keys):
                break
        else:
            raise ValueError("the keys aren't distinct")
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left, placed = hashes, 0
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = _mixed(left, len(self.bits)) % np.uint64(size)
            taken = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.bits.append(taken)
            self.ranks.append(placed + np.cumsum(taken) - taken)
            placed += int(taken.sum())
            left = left[~taken[at]]
        #: At the place of each key: its number in keys.
        self.number = np.empty(len(keys), np.int64)
        self.number[self._places(hashes)] = np.arange(len(keys))

    def hashes(self, keys) -> np.ndarray:
        seed, digest = self.seed, xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (taken, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = (_mixed(hashes[left], level) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def find(self, items: list[bytes]) -> list[int]:
        """The number of each item in keys, -1 for those that aren't there."""
        if not self.keys:
            return [-1] * len(items)
        places = self._places(self.hashes(items))
        numbers, keys = np.where(places < 0, -1, self.number[places]).tolist(), self.keys
        return [n if n >= 0 and keys[n] == item else -1 for n, item in zip(numbers, items)]


def merger(vocabulary: list[bytes]):
    """A function of bytes to the ranks that byte pair encoding gives them: lowest rank first, leftmost first among equals.

    A part is known by where it begins; end links it to the part after it and
    before to the one in front, and a heap has the pairs that can merge, as one
    integer each of rank, place and end.  n log n for a piece of n bytes.
    """
    rank_of = {token: rank for rank, token in enumerate(vocabulary)}.get
    heapify, pop, push = heapq.heapify, heapq.heappop, heapq.heappush

    def merge(piece: bytes) -> list[int]:
        n = len(piece)
        width = n.bit_length()
        mask, high = (1 << width) - 1, 2 * width
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << high | i << width | i + 2 for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = pop(heap)
            stop, i = top & mask, top >> width & mask
            j = end[i]  # 0 if the part was merged away
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank_of(piece[i : end[stop]])) is not None:
                    push(heap, r << high | i << width | end[stop])
            if (h := before[i]) >= 0 and (r := rank_of(piece[h:stop])) is not None:
                push(heap, r << high | h << width | stop)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : end[i]]))
            i = end[i]
        return out

    return merge


class BulkMerger:
    """The same merges for many short pieces at once.

    The pieces of one width form the rows of arrays: end and before link the
    parts of a row, and a winner tree (a heap in an array, the least of two
    children above them) has rank and place of each pair that can merge.  Each
    step pops the root of every row, merges there, and mends the tree from the
    leaves that changed.
    """

    #: Widths of rows; longer pieces go through merger().
    WIDTHS = (8, 16, 32)
    #: Rows at once: few enough that their trees stay in a core's cache.
    ROWS = 8_192
    _NONE = np.int64(2**62)

    def __init__(self, vocabulary: list[bytes]):
        numbers = {token: i for i, token in enumerate(vocabulary)}
        self.size = len(vocabulary)
        pairs = [(a * self.size + b, i) for i, t in enumerate(vocabulary) for k in range(1, len(t)) if (a := numbers.get(t[:k])) is not None and (b := numbers.get(t[k:])) is not None]
        pairs.sort()
        self.left_right = np.array([p for p, _ in pairs] + [2**62], np.int64)
        self.joined = np.array([i * 64 for _, i in pairs] + [0], np.int64)
        self.of_byte = np.array([numbers.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _key(self, left, right, place):
        """rank * 64 + place of a pair, or _NONE; a token of -1 stands for no part."""
        wanted = left * self.size + right
        at = self.left_right.searchsorted(wanted)
        return np.where((self.left_right[at] == wanted) & (left >= 0) & (right >= 0), self.joined[at] + place, self._NONE)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Of each piece, its ranks as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for width in self.WIDTHS:
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            for start in range(0, len(chosen), self.ROWS):
                part = chosen[start : start + self.ROWS].tolist()
                for i, ids in zip(part, self._rows([pieces[i] for i in part], lengths[part], width)):
                    out[i] = ids
            low = width
        return out

    def _rows(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        n, wide = len(pieces), width + 1
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        place = np.arange(width)
        token = np.full((n, wide), -1, np.int64)
        token[:, :width] = np.where(place < lengths[:, None], self.of_byte[raw], -1)
        end = np.full((n, wide), width, np.int64)
        end[:, :width] = np.minimum(place + 1, lengths[:, None])
        before = np.broadcast_to(np.arange(-1, width), (n, wide)).copy()
        tree = np.full((n, 2 * width), self._NONE, np.int64)
        tree[:, width:] = self._key(token[:, :-1], token[:, 1:], place)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        token, end, before, tree = token.ravel(), end.ravel(), before.ravel(), tree.ravel()  # from here on, places count through all rows
        levels = width.bit_length() - 1

        def mend(tops, i, key):
            node = i + width
            tree[tops + node] = key
            for _ in range(levels):
                key = np.minimum(key, tree[tops + (node ^ 1)])
                node = node >> 1
                tree[tops + node] = key

        rows = np.flatnonzero(tree[1 :: 2 * width] != self._NONE)
        while len(rows):
            base, tops = rows * wide, rows * (2 * width)
            top = tree[tops + 1]
            i, rank = top & 63, top >> 6
            at = base + i
            j = end[at]
            stop = end[base + j]
            token[at], token[base + j] = rank, -1
            end[at] = stop
            before[base + stop] = i  # of the row's end, which nothing reads
            mend(tops, j, np.full(len(rows), self._NONE))
            mend(tops, i, self._key(rank, token[base + stop], i))
            h = before[at]
            back = np.flatnonzero(h >= 0)
            h = h[back]
            mend(tops[back], h, self._key(token[base[back] + h], rank[back], h))
            rows = rows[tree[tops + 1] != self._NONE]
        token = token.reshape(n, wide)
        kept = token >= 0
        flat, cuts = token[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]


# Letters of Latin scripts from U+00C0 to U+024F, where all but the two signs are letters.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7e{_LATIN}]*").fullmatch
_CLASSES = {r"[^\s\p{L}\p{N}]": rf"[^\t-\r {_LATIN}0-9]", r"\p{L}": f"[{_LATIN}]", r"\p{N}": "[0-9]", r"\S": r"[^\t-\r ]", r"\s": r"[\t-\r ]"}


def splitter(pattern: str):
    """A function of a text to its pre-tokens.

    Text of Latin letters goes through the standard library's faster matcher,
    with the pattern's classes spelled out; the rest through the full one.  A
    pattern with other constructs than these classes always takes the full one.
    """
    full, plain = regex.compile(pattern).findall, pattern
    for name, spelled in _CLASSES.items():
        plain = plain.replace(name, spelled)
    if "\\" in plain.replace(r"\t", "").replace(r"\r", "") or "(?i" in plain:
        return full
    quick = re.compile(plain).findall
    return lambda text: quick(text) if _PLAIN(text) else full(text)


class Codec:
    """Encodes texts to ids and ids to bytes by a list of byte strings and a pattern of pre-tokens."""

    #: Resolved pre-tokens kept for later batches; beyond this many the memory starts anew.
    KEPT = 500_000

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        self.known = MinimalPerfectHash(vocabulary)
        self.merge, self.merge_many = merger(vocabulary), BulkMerger(vocabulary)
        self.packed = [int(i).to_bytes(4, "little") for i in range(len(vocabulary))]
        self.array = pa.array(vocabulary, pa.large_binary())
        self.resolved: dict[str, bytes] = {}

    def _resolve(self, tokens: list[str]) -> None:
        """Puts the ids of tokens into resolved: first by the perfect hash, the misses by merges."""
        pieces, packed = [t.encode("utf-8", "surrogatepass") for t in tokens], self.packed
        numbers = self.known.find(pieces)
        self.resolved.update((t, packed[n]) for t, n in zip(tokens, numbers) if n >= 0)
        missed = [i for i, n in enumerate(numbers) if n < 0]
        short = [i for i in missed if len(pieces[i]) <= BulkMerger.WIDTHS[-1]]
        for i, ids in zip(short, self.merge_many([pieces[i] for i in short])):
            self.resolved[tokens[i]] = ids
        for i in missed:
            if len(pieces[i]) > BulkMerger.WIDTHS[-1]:
                self.resolved[tokens[i]] = b"".join([packed[r] for r in self.merge(pieces[i])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        distinct: set[str] = set().union(*split)
        if len(self.resolved) > self.KEPT:
            self.resolved = {}
        self._resolve(list(distinct.difference(self.resolved)))
        lookup = self.resolved.__getitem__
        out = [b"".join(map(lookup, tokens)) for tokens in split]
        for token in distinct:
            if len(token) > 64:  # long ones seldom come again
                self.resolved.pop(token, None)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each run of ids stands for."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        tokens = self.array.take(pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
        _, offsets, data = tokens.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(tokens) + 1, tokens.offset * 8)
        cuts = bounds[np.concatenate([[0], np.cumsum(counts)])].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        return [whole[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a ranks file, made once for each worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again: one row per row of df.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids also
    ids (the array of ids).  path must be readable on every executor.  Null
    and empty texts have no ids; null and repeated ids of rows stay, a row
    each; an empty table gives an empty table.  One scan, no shuffle.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))

    def make():
        own, sha = codec(path, pattern), hashlib.sha256

        def work(part: list[str]):
            ids = own.encode(part)
            decoded = own.decode(ids)
            out = [[len(x) // 4 for x in ids], [sha(x).hexdigest() for x in ids], [sha(x).hexdigest() for x in decoded]]
            return [*out, [np.frombuffer(x, "<u4").astype(np.int64) for x in ids]] if with_ids else out

        return work

    return map_texts(df, id_col, text_col, fields, make)
