"""A Katz backoff model of n-grams, trained on a table and evaluated on it.

Counts are discounted after Good and Turing; what a context loses goes to the
words that never followed it, by the model one order below, with a weight that
makes each context's probabilities sum to 1 exactly.  So every token is
evaluated recursively, from the longest context down to single words, which back
off to one class for all words never seen.

How it scales: a scan turns documents into chunks, whose tokens are places in
the chunk's own list of words.  From then on only packed lists travel: order by
order, each chunk asks the buckets (partitions of the tables of counts) for its
distinct n-grams and gets back, in the order it asked, their numbers and counts
and what the backoff weights of its contexts are made of.  An n-gram is asked for
as the number of its context, which the order below has given, and that of its
word.  All are pre-aggregated by chunk.  N-grams are at home with their context,
but those of contexts too frequent for one bucket are dealt out by n-gram, and
their sums meet in a step of their own.  Chunks are written bucketed, so they stay
where they are and only replies are shuffled to them.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import clean_shuffles, drop_path, drop_tables, fresh_path, table
from .common import arrow_schema, fold_of, ready, slices

ORDER = 3
CHUNK_TOKENS = 1_250_000
#: Entries of a bucket, on average, at most: tokens asked about.
BUCKET_ENTRIES = 1_000_000
#: Counts up to this are discounted.
K = 5
HELD = (5, 1)  # folds, and the one that isn't trained on

END = np.uint64(xxhash.xxh3_64_intdigest(b"\0end of document"))
#: The identifier of the context that is only ends, before a document's first word.
START = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: What travels: kind, order, whose it is (chunk), where it belongs (bucket), and packed arrays.
ROW = pa.schema([("kind", pa.string()), ("order", pa.int32()), ("chunk", pa.string()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in "abcdefg"], ("hist", pa.list_(pa.struct([("r", pa.int64()), ("n", pa.int64())])))])
_DDL = "kind string, `order` int, chunk string, bucket int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, hist array<struct<r: long, n: long>>"


def pack(x: np.ndarray) -> bytes:
    """An array, its bytes by place (so that equal high bytes meet) and compressed."""
    x = np.ascontiguousarray(x)
    if x.dtype.itemsize == 1 or not len(x):
        return zstandard.ZstdCompressor(level=1).compress(x.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw, kind = zstandard.ZstdDecompressor().decompress(data), np.dtype(kind)
    if kind.itemsize == 1 or not raw:
        return np.frombuffer(raw, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array: small numbers, which pack well."""
    return np.diff(x, prepend=x.dtype.type(0))


def ungaps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def rows(*given: dict) -> pa.Table:
    return pa.Table.from_pylist([{f: r.get(f) for f in ROW.names} for r in given], schema=ROW)


def histogram(counts: np.ndarray) -> dict[int, int]:
    """How many counts are r, by r above 0."""
    return dict(zip(*(x.tolist() for x in np.unique(counts[counts > 0], return_counts=True))))


def slope(hist: dict[int, int]) -> float | None:
    """Of Gale's line through the logs of r and of the counts of counts, each spread over the gap to its neighbours."""
    if len(hist) < 2:
        return None
    r = np.array(sorted(hist), np.float64)
    n = np.array([hist[int(x)] for x in r], np.float64)
    before = np.concatenate([[0.0], r[:-1]])
    after = np.concatenate([r[1:], [2 * r[-1] - before[-1]]])
    return float(np.polyfit(np.log(r), np.log(2 * n / (after - before)), 1)[0])


def discounts(hist: dict[int, int]) -> list[float]:
    """The factors of counts 1 to K by Good and Turing, as Katz scales them: together they free as much as there is in counts of 1.

    Groups of copies bend the counts of counts: from the first count whose own
    estimate doesn't hold, estimates are those of Gale's line.  Absolute
    discounting is left where there is nothing to estimate from: no count of 1,
    none of 2 to K, or a line that doesn't fall fast enough (slope -1).
    """
    n, line = [0, *(hist.get(r, 0) for r in range(1, K + 2))], slope(hist)
    own = [(r + 1) * n[r + 1] / (r * n[r]) if n[r] else math.inf for r in range(1, K + 1)]
    if n[1] and any(n[2 : K + 1]):
        for kept in range(K, -1, -1):
            if kept < K and (line is None or line >= -1):
                break
            left = [own[r - 1] if r <= kept else ((r + 1) / r) ** (line + 1) for r in range(1, K + 1)]
            lost = sum(r * n[r] * (1 - x) for r, x in zip(range(1, K + 1), left) if n[r])
            found = [1 - n[1] / lost * (1 - x) for x in left] if lost > 0 else []
            if found and all(0 < d < 1 for d in found):
                return found
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [(r - off) / r for r in range(1, K + 1)]


@dataclass
class Unigrams:
    """Probabilities of single words by their counts; what discounting frees belongs to the words never seen."""

    hist: dict[int, int]

    def __post_init__(self):
        self.total, self.kinds = sum(r * n for r, n in self.hist.items()), sum(self.hist.values())
        factors = discounts(self.hist)
        self.freed = sum(self.hist.get(r, 0) * r * (1 - d) for r, d in zip(range(1, K + 1), factors)) / self.total if self.total else 1.0
        self.factors = np.array([0.0, *factors, 1.0])
        self.scale = 1.0
        if self.freed <= 0:  # no low counts at all: one count of total + 1 for what is unseen
            self.freed, self.scale = 1 / (self.total + 1), self.total / (self.total + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.factors[np.minimum(counts, K + 1)] * counts * (self.scale / self.total), self.freed)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))


def chunks(df: DataFrame, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    """A row per chunk: its ids, and packed the tokens (places in words), words, their training counts, tokens of each document and whether it trains; and the place of the end among the words."""
    ready(df)
    read = df.select(F.struct(F.col(id_col).alias("id"), (fold_of(id_col, HELD[0]) != HELD[1]).alias("train")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = arrow_schema(df, id_col)[0].type
    schema = pa.schema([("chunk", pa.string()), ("ids", pa.list_(id_type)), *[(c, pa.binary()) for c in ("codes", "words", "counts", "lengths", "train")], ("end", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        ids, trains, lengths, parts, n = [], [], [], [], 0

        def flush():
            words, codes = np.unique(np.concatenate(parts), return_inverse=True)
            of = np.array(lengths, np.uint32)
            train = np.array(trains, np.uint8)
            counts = np.bincount(codes, np.repeat(train, of), len(words)).astype(np.uint32)
            packed = (pack(codes.astype(np.uint32)), pack(gaps(words)), pack(counts), pack(of), pack(train))
            all_ids = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), listed, *[pa.array([x], pa.binary()) for x in packed], *[pa.array([int(x)], pa.int64()) for x in (np.searchsorted(words, END), len(words), len(codes))]], schema=schema)

        for b in batches:
            for keys, part in slices(b):
                ids.append(keys.field(0))
                trains += keys.field(1).to_pylist()
                for text in part:
                    tokens = text.encode("utf-8", "surrogatepass").lower().split()
                    own = np.fromiter((digest(t) for t in tokens), np.uint64, len(tokens))
                    parts += [own, END[None]]
                    lengths.append(len(own) + 1)
                    n += len(own) + 1
                if n >= chunk_tokens:
                    yield flush()
                    ids, trains, lengths, parts, n = [], [], [], [], 0
        if lengths:
            yield flush()

    ddl = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), *[T.StructField(c, T.BinaryType()) for c in ("codes", "words", "counts", "lengths", "train")], *[T.StructField(c, T.LongType()) for c in ("end", "entries", "tokens")]])
    return read.mapInArrow(run, ddl)


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of hashes: ranges of their upper halves."""
    return (((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Hashes of identifiers."""
    x = (ids ^ (ids >> np.uint64(29))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(31))


def home_of(context_ids: np.ndarray, orders: dict[int, Order], order: int) -> np.ndarray:
    """The bucket of contexts: by the bucket in which they were counted themselves, so that neighbours stay neighbours and their gaps small."""
    own, below = orders[order].buckets, orders[order - 1].buckets
    return ((context_ids >> np.uint64(32)) * np.uint64(own) // np.uint64(below)).astype(np.int64).clip(0, own - 1)


def rank_of(ids: np.ndarray) -> np.ndarray:
    """The place of each identifier among all in order."""
    out = np.empty(len(ids), np.int64)
    out[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return out


def runs(keys: np.ndarray):
    """(key, start, stop) of each run of equal values of a sorted array."""
    if len(keys):
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        yield from ((int(keys[a]), a, b) for a, b in zip(cuts, cuts[1:]))


def ask_words(made: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind ask: a chunk's words of a bucket, and their counts in the chunk."""

    def run(batches):
        for b in batches:
            for chunk, words, counts in zip(*(c.to_pylist() for c in b.columns)):
                words, counts = ungaps(unpack(words, np.uint64)), unpack(counts, np.uint32)
                yield from rows(*({"kind": "ask", "chunk": chunk, "bucket": k, "a": pack(gaps(words[i:j])), "b": pack(counts[i:j])} for k, i, j in runs(bucket_of(words, buckets)))).to_batches()

    return made.select("chunk", "words", "counts").mapInArrow(run, _DDL)


def count_words(t: pa.Table) -> pa.Table:
    """A bucket's words with their counts (kind model), and to each chunk the numbers and counts of the words it asked for (kind reply).

    Numbers begin with the most frequent word, so that most are small.
    """
    asked = t.sort_by("chunk").to_pylist()
    lists = [ungaps(unpack(r["a"], np.uint64)) for r in asked]
    words, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate([unpack(r["b"], np.uint32) for r in asked]), len(words)).astype(np.uint64)
    numbers = np.empty(len(words), np.uint32)
    numbers[np.argsort(-totals.astype(np.int64), kind="stable")] = np.arange(len(words), dtype=np.uint32)
    bucket = asked[0]["bucket"]
    out = [{"kind": "model", "order": 1, "bucket": bucket, "a": pack(gaps(words)), "b": pack(totals), "c": pack(numbers), "hist": [{"r": r, "n": n} for r, n in histogram(totals).items()]}]
    for r, own in zip(asked, np.split(inverse, np.cumsum([len(x) for x in lists])[:-1])):
        out.append({"kind": "reply", "order": 1, "chunk": r["chunk"], "bucket": bucket, "a": pack(numbers[own]), "b": pack(totals[own])})
    return rows(*out)


@dataclass
class Order:
    """How one order is dealt to buckets: how many there are, and from which count on a context is too frequent for one."""

    buckets: int
    hot: float
    factors: np.ndarray | None = None  # of counts 0 to K + 1, once known


def factors_of(hist: dict[int, int]) -> np.ndarray:
    return np.array([0.0, *discounts(hist), 1.0])


class Level:
    """A chunk's distinct n-grams of one order: of each token its n-gram (code); of each n-gram its context (a place among the n-grams one order below, or START after them), word and shorter n-gram; and what the chunk has been told."""

    def __init__(self, codes: np.ndarray, contexts: np.ndarray, words: np.ndarray, shorter: np.ndarray, hist: np.ndarray, context_ids: np.ndarray):
        self.codes, self.contexts, self.words, self.shorter = codes, contexts, words, shorter
        self.hist, self.context_ids = hist, context_ids
        self.totals = np.zeros(len(words), np.int64)
        self.ids = np.zeros(len(words), np.uint64)
        self.none = np.zeros(len(hist), bool)  # contexts that lost nothing to discounting
        self.weights = np.ones(len(hist))


class Chunk:
    """A chunk with what it has been told so far."""

    def __init__(self, chunk: dict, replies: list[dict], orders: dict[int, Order], unigrams: Unigrams):
        self.orders, self.unigrams = orders, unigrams
        self.codes, self.lengths = unpack(chunk["codes"], np.uint32).astype(np.int64), unpack(chunk["lengths"], np.uint32).astype(np.int64)
        self.train = np.repeat(unpack(chunk["train"], np.uint8), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.zeros(len(self.codes), bool)
        self.first[self.starts] = True
        of = {}
        for r in replies:
            of.setdefault((r["kind"], r["order"]), []).append(r)
        self.told = {k: sorted(v, key=lambda r: r["bucket"]) for k, v in of.items()}
        mine = self.told["reply", 1]
        numbers = [unpack(r["a"], np.uint32).astype(np.uint64) for r in mine]
        home = np.repeat(np.array([r["bucket"] for r in mine], np.uint64), [len(x) for x in numbers])
        numbers = np.concatenate(numbers)
        one = Level(self.codes, np.zeros(0, np.int64), np.arange(len(numbers)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        one.totals = np.concatenate([unpack(r["b"], np.uint64) for r in mine]).astype(np.int64)
        one.ids = (home << np.uint64(32)) | numbers
        self.levels = {1: one}
        self.documents = one.totals[chunk["end"]]  # trained on: as often as there is an end

    def extend(self, order: int) -> Level:
        """The level of an order, one above the last."""
        below, words = self.levels[order - 1], self.levels[1]
        n = len(words.ids)
        contexts = np.empty(len(self.codes), np.int64)
        contexts[1:] = below.codes[:-1]
        contexts[self.starts] = len(below.ids)
        keys, place, codes = np.unique(contexts * n + self.codes, return_index=True, return_inverse=True)
        hist, ids = np.append(below.totals, self.documents), np.append(below.ids, START)
        made = self.levels[order] = Level(codes, keys // n, keys % n, below.codes[place], hist, ids)
        return made

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams in the order of asking (by bucket, then context, then word), and their buckets; contexts never trained on have nothing to ask."""
        level, how, words = self.levels[order], self.orders[order], self.levels[1]
        known = np.flatnonzero(level.hist[level.contexts] > 0)
        contexts, own = level.contexts[known], level.words[known]
        sorted_ = np.argsort(rank_of(level.context_ids)[contexts] * len(words.ids) + rank_of(words.ids)[own], kind="stable")
        contexts, own, known = contexts[sorted_], own[sorted_], known[sorted_]
        hot = (level.hist > how.hot)[contexts]
        dealt = home_of(level.context_ids, self.orders, order)[contexts]
        dealt[hot] = bucket_of(mixed(mixed(level.context_ids[contexts[hot]]) ^ words.ids[own[hot]]), how.buckets)
        sorted_ = np.argsort(dealt, kind="stable")
        return known[sorted_], dealt[sorted_]

    def needs(self, order: int) -> np.ndarray:
        """Of each context: 2 if it's hot, 1 if its weight can be needed (an n-gram of it that the chunk doesn't train on), else 0."""
        level = self.levels[order]
        trained = np.bincount(level.codes, self.train, len(level.words)) > 0
        needed = np.zeros(len(level.hist), np.uint8)
        needed[level.contexts[~trained]] = 1
        needed[level.hist > self.orders[order].hot] = 2
        return needed

    def hear(self, order: int) -> None:
        """Takes in what the chunk was told of an order."""
        level, how = self.levels[order], self.orders[order]
        gram, dealt = self.asked(order)
        needed = self.needs(order)
        mine = self.told.get(("reply", order), [])
        if mine:
            level.totals[gram] = np.concatenate([unpack(r["b"], np.uint64) for r in mine]).astype(np.int64)
            numbers = np.concatenate([ungaps(unpack(r["a"], np.uint32)) for r in mine]).astype(np.uint64)
            level.ids[gram] = (dealt.astype(np.uint64) << np.uint64(32)) | numbers
        for r, (_, i, j) in zip(mine, runs(dealt)):
            contexts = level.contexts[gram[i:j]]
            own = contexts[[a for _, a, _ in runs(contexts)]]
            cool = own[needed[own] < 2]
            level.none[cool] = unpack(r["c"], np.uint8).astype(bool)
            wanted = own[needed[own] == 1]
            lower, low_counts = unpack(r["d"], np.float64), unpack(r["e"], np.uint64).reshape(K, -1).astype(np.float64)
            level.weights[wanted] = weights_of(low_counts, lower, level.hist[wanted], how.factors)
        hot = self.hot(order)
        for r, (_, i, j) in zip(self.told.get(("weight", order), []), runs(home_of(level.context_ids[hot], self.orders, order))):
            got = unpack(r["a"], np.float64)
            level.weights[hot[i:j]], level.none[hot[i:j]] = np.abs(got), got < 0
        level.weights[level.hist == 0] = 1.0

    def hot(self, order: int) -> np.ndarray:
        """The hot contexts in the order of asking for their weights."""
        level = self.levels[order]
        used = np.zeros(len(level.hist), bool)
        used[level.contexts] = True
        hot = np.flatnonzero(used & (level.hist > self.orders[order].hot))
        return hot[np.lexsort((level.context_ids[hot], home_of(level.context_ids[hot], self.orders, order)))]

    def probabilities(self, order: int) -> np.ndarray:
        """Of each of the chunk's n-grams, by recursion."""
        level = self.levels[order]
        if order == 1:
            return self.unigrams.p(level.totals)
        lower = self.probabilities(order - 1)
        hist, none = level.hist[level.contexts], level.none[level.contexts]
        seen = self.orders[order].factors[np.minimum(level.totals, K + 1)] * level.totals / np.maximum(hist, 1) * np.where(none, hist / (hist + 1), 1.0)
        return np.where(level.totals > 0, seen, level.weights[level.contexts] * lower[level.shorter])


def weights_of(low_counts: np.ndarray, lower: np.ndarray, hist: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts: from how many of their words have each count up to K, the probability of their words one order below, and their counts.

    A context that lost nothing to discounting gives one count of its own plus one.
    """
    freed = sum(r * (1 - factors[r]) * low_counts[r - 1] for r in range(1, K + 1)) / np.maximum(hist, 1)
    freed = np.where(low_counts.sum(0) == 0, 1 / (hist + 1), freed)
    return freed / np.maximum(1 - lower, 1e-12)


def ask_grams(chunk: dict, replies: list[dict], order: int, orders: dict[int, Order], unigrams: Unigrams) -> pa.Table:
    """A chunk's questions of an order.

    Kind ask, by bucket: contexts, how many words follow each, whether its weight
    is needed, and how often its own shorter context was seen (below 0 if that
    lost nothing to discounting); words, their counts in the chunk's training,
    and those of the shorter n-grams, which are what the lower order's
    probability of a seen n-gram is made of.  Kind hot: contexts whose weights
    are asked for.
    """
    own = Chunk(chunk, replies, orders, unigrams)
    for k in range(2, order + 1):
        own.extend(k)
        if k < order:
            own.hear(k)
    level, below = own.levels[order], own.levels[order - 1]
    counts = np.bincount(level.codes, own.train, len(level.words)).astype(np.uint32)
    needed, out = own.needs(order), []
    if order > 2:
        inner = below.contexts[level.shorter]
        base = np.where(below.none[inner], -1, 1) * below.hist[inner]
    else:
        base = np.zeros(len(level.words), np.int64)
    gram, dealt = own.asked(order)
    for k, i, j in runs(dealt):
        grams = gram[i:j]
        contexts = level.contexts[grams]
        first = np.array([a for _, a, _ in runs(contexts)])
        each = np.diff(np.append(first, len(grams))).astype(np.uint32)
        lists = (gaps(level.context_ids[contexts[first]]), each, needed[contexts[first]], base[grams[first]], own.levels[1].ids[level.words[grams]], counts[grams], below.totals[level.shorter[grams]].astype(np.uint64))
        out.append({"kind": "ask", "order": order, "chunk": chunk["chunk"], "bucket": k} | {c: pack(x) for c, x in zip("abcdefg", lists)})
    hot = own.hot(order)
    for k, i, j in runs(home_of(level.context_ids[hot], orders, order)):
        out.append({"kind": "hot", "order": order, "chunk": chunk["chunk"], "bucket": k, "a": pack(level.context_ids[hot[i:j]])})
    return rows(*out)


def count_grams(t: pa.Table, order: int, orders: dict[int, Order], unigrams: Unigrams) -> pa.Table:
    """Of a bucket: its n-grams' counts (kind model), replies (kind reply), the sums of its share of hot contexts (kind part, by the context's own bucket), and the questions for those as they were (kind hot)."""
    listed = t.sort_by("chunk").to_pylist()
    out = [r for r in listed if r["kind"] == "hot"]
    asked = [r for r in listed if r["kind"] == "ask"]
    if not asked:
        return rows(*out)
    bucket, lists = asked[0]["bucket"], [[unpack(r[c], kind) for c, kind in zip("abcdefg", (np.uint64, np.uint32, np.uint8, np.int64, np.uint64, np.uint32, np.uint64))] for r in asked]
    ids = [ungaps(x[0]) for x in lists]
    context_ids, at = np.unique(np.concatenate(ids), return_inverse=True)
    own_contexts = np.split(at, np.cumsum([len(x) for x in ids])[:-1])
    base = np.zeros(len(context_ids), np.int64)
    base[at] = np.concatenate([x[3] for x in lists])
    hot = np.zeros(len(context_ids), bool)
    hot[at] = np.concatenate([x[2] for x in lists]) == 2
    context = np.concatenate([np.repeat(own, x[1]) for own, x in zip(own_contexts, lists)])
    word_ids, word = np.unique(np.concatenate([x[4] for x in lists]), return_inverse=True)
    keys, first, inverse = np.unique(context * len(word_ids) + word, return_index=True, return_inverse=True)
    totals = np.bincount(inverse, np.concatenate([x[5] for x in lists]), len(keys)).astype(np.int64)
    shorter = np.concatenate([x[6] for x in lists])[first].astype(np.int64)
    context, word = keys // len(word_ids), keys % len(word_ids)

    seen = np.flatnonzero(totals > 0)
    of, n = context[seen], len(context_ids)
    if order == 2:
        below = unigrams.p(shorter[seen])
    else:
        times = np.abs(base[of])
        below = orders[order - 1].factors[np.minimum(shorter[seen], K + 1)] * shorter[seen] / np.maximum(times, 1) * np.where(base[of] < 0, times / (times + 1), 1.0)
    lower = np.bincount(of, below, n)
    low_counts = np.stack([np.bincount(of, totals[seen] == r, n) for r in range(1, K + 1)]).astype(np.uint64)
    none = (low_counts.sum(0) == 0).astype(np.uint8)

    for r, x, contexts, own in zip(asked, lists, own_contexts, np.split(inverse, np.cumsum([len(x[4]) for x in lists])[:-1])):
        cool, wanted = contexts[x[2] < 2], contexts[x[2] == 1]
        told = (gaps(own.astype(np.uint32)), totals[own].astype(np.uint64), none[cool], lower[wanted], low_counts[:, wanted].ravel())
        out.append({"kind": "reply", "order": order, "chunk": r["chunk"], "bucket": bucket} | {c: pack(y) for c, y in zip("abcde", told)})
    out.append({"kind": "model", "order": order, "bucket": bucket, "a": pack(gaps(context_ids[of])), "b": pack(word_ids[word[seen]]), "c": pack(totals[seen].astype(np.uint64)), "hist": [{"r": r, "n": n} for r, n in histogram(totals).items()]})
    shared = np.flatnonzero(hot)
    home = home_of(context_ids[shared], orders, order)
    big = np.bincount(of, np.where(totals[seen] > K, totals[seen], 0), n).astype(np.uint64)
    shared = shared[np.argsort(home, kind="stable")]
    for k, i, j in runs(np.sort(home)):
        own = shared[i:j]
        out.append({"kind": "part", "order": order, "bucket": k, "a": pack(context_ids[own]), "b": pack(np.vstack([low_counts[:, own], big[None, own]]).ravel()), "c": pack(lower[own])})
    return rows(*out)


def weigh(t: pa.Table, factors: np.ndarray) -> pa.Table:
    """To each chunk, the backoff weights of the hot contexts it asked for (kind weight); below 0 where the context lost nothing to discounting."""
    listed = t.sort_by("chunk").to_pylist()
    asked, parts = [r for r in listed if r["kind"] == "hot"], [r for r in listed if r["kind"] == "part"]
    if not asked or not parts:
        return ROW.empty_table()
    ids, inverse = np.unique(np.concatenate([unpack(r["a"], np.uint64) for r in parts]), return_inverse=True)
    lower = np.bincount(inverse, np.concatenate([unpack(r["c"], np.float64) for r in parts]), len(ids))
    sums = np.concatenate([unpack(r["b"], np.uint64).reshape(K + 1, -1) for r in parts], axis=1).astype(np.float64)
    sums = np.stack([np.bincount(inverse, s, len(ids)) for s in sums])
    times = sums[K] + sum(r * sums[r - 1] for r in range(1, K + 1))
    weights = weights_of(sums[:K], lower, times, factors) * np.where(sums[:K].sum(0) == 0, -1, 1)
    return rows(*({"kind": "weight", "order": r["order"], "chunk": r["chunk"], "bucket": r["bucket"], "a": pack(weights[np.searchsorted(ids, unpack(r["a"], np.uint64))])} for r in asked))


def score_documents(df: DataFrame, id_col: str, text_col: str, *, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of df: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows whose crc32 of the id modulo 5 is not 1.  A token's
    context is the order - 1 tokens before it in its document, with ends before
    the first.  Words are compared by 64-bit hashes, A-Z lowered.  A null text
    is empty: its one token is the end.  Null and repeated ids stay, a row each,
    and repeated rows train each.  Without training rows every token has
    probability 1.  An empty table gives an empty table.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    made = table(chunks(df, id_col, text_col, chunk_tokens), "katz-texts")
    entries, tokens = made.agg(F.sum("entries"), F.sum("tokens")).first()
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = []

    def place(rows: DataFrame) -> DataFrame:
        """rows in a table bucketed by chunk: what is grouped by chunk stays where it is."""
        name, where = f"katz_{uuid.uuid4().hex}", fresh_path(spark, "katz-placed")
        with clean_shuffles(spark):
            rows.repartition(tasks, "chunk").write.bucketBy(tasks, "chunk").option("path", where).option("compression", "zstd").saveAsTable(name)
        out = spark.table(name)
        out._table_path, out._name = where, name
        placed.append(out)
        return out

    def forget() -> None:
        """Removes the oldest table that place() made."""
        out = placed.pop(0)
        spark.sql(f"drop table {out._name}")
        drop_tables(out)

    def whole(counted: DataFrame) -> dict[int, int]:
        """The histogram over all buckets: its distinct counts number at most the root of twice the tokens."""
        found = counted.filter("kind = 'model'").selectExpr("inline(hist)").groupBy("r").agg(F.sum("n").alias("n"))
        return {r["r"]: r["n"] for r in found.collect()}

    def by_bucket(asking: DataFrame, buckets: int, function) -> DataFrame:
        return asking.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(function, _DDL)

    def told(rows: DataFrame) -> DataFrame:
        return rows.filter("kind in ('reply', 'weight')").select("kind", "order", "chunk", "bucket", "a", "b", "c", "d", "e")

    def by_chunk(replies: DataFrame, columns: tuple, function, ddl) -> DataFrame:
        """function of each chunk and the replies to it; the chunks stay in place."""
        return texts.select("chunk", "end", *columns).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(function, ddl)

    # Spark counts the arguments of what it calls, so the order goes in by closure.
    asks = lambda k: lambda own, told: ask_grams(own.to_pylist()[0], told.to_pylist(), k, orders, unigrams)
    counts = lambda k: lambda t: count_grams(t, k, orders, unigrams)
    weights = lambda k: lambda t: weigh(t, orders[k].factors)

    orders = {1: Order(max(least, math.ceil((entries or 0) / bucket_entries)), math.inf)}
    kept = [table(by_bucket(ask_words(made, orders[1].buckets), orders[1].buckets, count_words), "katz-1", "kind")]
    unigrams = Unigrams(whole(kept[0]))
    lists = ("codes", "lengths", "train")
    texts = place(made.select("chunk", "ids", "end", *lists))
    drop_tables(made)  # the words themselves aren't needed any more: they have numbers
    replies, counted_at = told(kept[0].select(*ROW.names)), kept[0]._table_path
    for k in range(2, order + 1):
        placed_replies = place(replies)
        drop_path(spark, f"{counted_at}/kind=reply")
        if k > 2:
            placed.insert(0, placed.pop(1))
            forget()
        buckets = max(least, math.ceil((tokens or 0) / bucket_entries))
        orders[k] = Order(buckets, max(1000.0, unigrams.total / (4 * buckets)))
        kept.append(table(by_bucket(by_chunk(placed_replies, lists, asks(k), _DDL), buckets, counts(k)), f"katz-{k}", "kind"))
        counted, counted_at = kept[-1].select(*ROW.names), kept[-1]._table_path
        orders[k].factors = factors_of(whole(counted))
        kept.append(table(by_bucket(counted.filter("kind in ('part', 'hot')"), buckets, weights(k)), f"katz-weights-{k}"))
        replies = placed_replies.unionByName(told(counted)).unionByName(told(kept[-1].select(*ROW.names)))

    first = arrow_schema(df, id_col)[0]
    schema = pa.schema([("_id", first.type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([c.flatten() for c in own.column("ids").chunks])
        chunk = Chunk(own.drop_columns(["ids"]).to_pylist()[0], told.to_pylist(), orders, unigrams)
        for k in range(2, order + 1):
            chunk.extend(k)
            chunk.hear(k)
        one = chunk.levels[1]
        total = lambda x: np.add.reduceat(x, chunk.starts)
        known, base = total((one.totals > 0).astype(np.int64)[one.codes]), total(np.log10(unigrams.base(one.totals))[one.codes])
        score = total(np.log10(chunk.probabilities(order))[chunk.levels[order].codes])
        return pa.table([ids, pa.array(chunk.lengths), pa.array(known), pa.array(base), pa.array(score)], schema=schema)

    ddl = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = table(by_chunk(replies.repartition(tasks, "chunk"), ("ids", *lists), finish, ddl), "katz-scores")
    while placed:
        forget()
    drop_tables(*kept)
    return scored.select(F.col("_id").alias(id_col), (fold_of("_id", HELD[0]) == HELD[1]).alias("held_out"), "n_tokens", "n_known", F.lit(unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")
