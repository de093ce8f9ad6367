"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, spell words: each gives the
probability of a word's next character by the ones before it in that word.
Both are interpolated Kneser-Ney models whose discounts are estimated from
counts of counts; their lowest orders are one model of both classes together.
A rare word, or one never seen, thus gets nearly the same probability from
either, and says little, unless its spelling is that of many words of a class.

A document's evidence is the difference of its two log-likelihoods over its
length in characters, and nothing else; a logistic fit of that one number turns
it into a probability.

The models are fitted to a bounded sample of labelled documents, each whole:
executors count words and spellings, the driver gets a row per spelling of
ORDER characters.  Scoring is one scan, in which each word is spelled once per
task.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts, ready, table
from .labelled import calibrated, sample_of, sampled_texts

#: Labelled documents of each class that the fit sees at most.
SAMPLE_PER_CLASS = 3_000
#: Characters of the longest spelling, and those up to which both classes share their counts.
ORDER, SHARED = 5, 2
#: Bits of a character in a spelling's code; rarer characters than fit in are one.
BITS = 12
THRESHOLD = 0.3
#: Words that a task remembers the evidence of.
REMEMBERED = 400_000

START, END, RARE = 0, 1, 2
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words_of(text: str) -> Counter:
    """The words of text, A-Z lowered and punctuation at their ends removed."""
    return Counter([w.strip(_PUNCTUATION) or w for w in text.translate(_LOWER).split()])


def alphabet_of(counts: dict[str, int]) -> np.ndarray:
    """The sorted code points that have a code of their own: the most frequent."""
    kept = sorted(counts, key=lambda c: (-counts[c], c))[: 2**BITS - 3]
    return np.array(sorted(map(ord, kept)), np.uint32)


def spellings(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last ORDER characters at each place of words (their ends included), and the places of each word.

    A code has its last character in the lowest bits; places before a word are START.
    """
    raw = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = raw == 10
    at = np.minimum(np.searchsorted(alphabet, raw), max(len(alphabet) - 1, 0))
    known = alphabet[at] == raw if len(alphabet) else np.zeros(len(raw), bool)
    own = np.where(ends, END, np.where(known, at + 3, RARE)).astype(np.uint64)
    lengths = np.diff(np.flatnonzero(ends), prepend=-1)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = own.copy()
    for j in range(1, ORDER):
        codes[j:] |= np.where(place[j:] >= j, own[:-j], START).astype(np.uint64) << np.uint64(BITS * j)
    return codes, lengths


def mask(order: int) -> np.uint64:
    return np.uint64((1 << (BITS * order)) - 1)


def orders_of(codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of each order from 1 to ORDER, from distinct codes of ORDER and their counts.

    Below the highest order a count is one of continuations: of the different
    characters before; at a word's start, where there is none, it's plain.
    """
    seen = counts > 0
    levels = [(codes[seen], counts[seen].astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        longer, n = levels[0]
        shorter, inverse = np.unique(longer & mask(order), return_inverse=True)
        starts = (longer >> np.uint64(BITS * (order - 1))) & mask(1) == START if order > 1 else np.zeros(len(longer), bool)
        levels.insert(0, (shorter, np.bincount(inverse, np.where(starts, n, 1.0), len(shorter))))
    return levels


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from the counts of counts (Chen and Goodman); a half where they say nothing."""
    n = [0, *(int((counts == r).sum()) for r in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    off = [r - (r + 1) * y * n[r + 1] / n[r] if n[r] else 0.5 for r in (1, 2, 3)]
    return np.array([0.0, *(d if 0 < d < r else 0.5 for r, d in zip((1, 2, 3), off))])


@dataclass
class Level:
    """One order: sorted codes; by class (row) the discounted share of each code in its context, and what each context leaves to the order below."""

    codes: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, classes: list[tuple[np.ndarray, np.ndarray]]) -> Level:
        codes = np.unique(np.concatenate([c for c, _ in classes]))
        contexts, context = np.unique(codes >> np.uint64(BITS), return_inverse=True)
        share, left = np.zeros((len(classes), len(codes))), np.ones((len(classes), len(contexts)))
        for row, (own, counts) in enumerate(classes):
            if not len(own):
                continue
            n = np.zeros(len(codes))
            n[np.searchsorted(codes, own)] = counts
            off = discounts(counts)[np.minimum(n, 3).astype(int)]
            total, freed = np.bincount(context, n, len(contexts)), np.bincount(context, off, len(contexts))
            share[row] = (n - off) / np.maximum(total, 1)[context]
            left[row] = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
        return cls(codes, share, contexts, left)

    def interpolate(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities by class (row) of the last characters of codes, given those one order below."""

        def find(keys, wanted):
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

        at, seen = find(self.codes, codes)
        context, known = find(self.contexts, codes >> np.uint64(BITS))
        share = np.where(seen, self.share[:, at], 0.0) if len(self.codes) else 0.0
        left = np.where(known, self.left[:, context], 1.0) if len(self.contexts) else 1.0
        return share + left * lower


class Models:
    """The models of ordinary (0) and toxic (1) documents, from codes of ORDER characters and their counts by class."""

    def __init__(self, alphabet: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.alphabet = alphabet
        classes, both = [orders_of(codes, counts[row]) for row in (0, 1)], orders_of(codes, counts.sum(0))
        self.levels = [Level.of([both[k]] if k < SHARED else [c[k] for c in classes]) for k in range(ORDER)]
        self.kinds = len(alphabet) + 2  # all characters that can come next

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """By class (row), of the last character of each code given those before it."""
        p = np.full((2, len(codes)), 1 / self.kinds)
        for k, level in enumerate(self.levels, 1):
            p = level.interpolate(codes & mask(k), p)
        return p

    def evidence(self, words: list[str]) -> tuple[list[float], list[int]]:
        """Of each word, the natural log of its toxic over its ordinary probability, and its characters, the end counted."""
        if not words:
            return [], []
        codes, lengths = spellings(words, self.alphabet)
        different, inverse = np.unique(codes, return_inverse=True)
        p = self.probabilities(different)
        ratios = np.log(p[1] / p[0])[inverse]
        return np.add.reduceat(ratios, np.cumsum(lengths) - lengths).tolist(), lengths.tolist()

    def reader(self):
        """A function of a list of texts to the difference of their log-likelihoods over their length; a text without words has none."""
        known: dict[str, tuple[float, int]] = {}

        def read(texts: list[str]) -> list[float]:
            counted = [words_of(t) for t in texts]
            new = list({w for c in counted for w in c if w not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({w for c in counted for w in c})
            known.update(zip(new, zip(*self.evidence(new))))
            out = []
            for c in counted:
                ratio = length = 0
                for w, n in c.items():
                    r, size = known[w]
                    ratio += n * r
                    length += n * size
                out.append(ratio / max(length, 1))
            return out

        return read


@dataclass
class Scorer:
    models: Models | None
    slope: float
    offset: float
    share: float

    def reader(self):
        """A function of a list of texts to their probabilities of label 1."""
        if self.models is None:
            return lambda texts: [self.share] * len(texts)
        read = self.models.reader()
        return lambda texts: [1 / (1 + math.exp(-min(max(self.slope * x + self.offset, -30.0), 30.0))) for x in read(texts)]


def count_words(sample: DataFrame) -> DataFrame:
    """_label, _half, word, n of the sampled documents."""
    schema = pa.schema([("_label", pa.int32()), ("_half", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for label, half, text in zip(*(c.to_pylist() for c in b.columns)):
                counted = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(counted), pa.int32()), pa.array([half] * len(counted), pa.int32()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], schema=schema)

    counted = sample.select("_label", "_half", "text").mapInArrow(run, "_label int, _half int, word string, n long")
    return counted.groupBy("_label", "_half", "word").agg(F.sum("n").alias("n"))


def models_of(sample: DataFrame) -> list[Models]:
    """Models of the first half of the sampled documents, of the second, and of all."""
    words = table(count_words(sample), "toxicity-words")
    characters = words.select("n", F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = alphabet_of({r["c"]: r["n"] for r in characters.collect()})  # no more rows than Unicode has characters
    schema = pa.schema([("_label", pa.int32()), ("_half", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes, lengths = spellings(b.column(2).to_pylist(), alphabet)
            repeat = lambda i: np.repeat(b.column(i).to_numpy(zero_copy_only=False), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(repeat(0), pa.int32()), pa.array(repeat(1), pa.int32()), pa.array(codes.view(np.int64)), pa.array(repeat(3), pa.int64())], schema=schema)

    spelled = words.mapInArrow(run, "_label int, _half int, code long, n long")
    cell = lambda label, half: F.sum(F.when((F.col("_label") == label) & (F.col("_half") == half), F.col("n")).otherwise(0)).alias(f"n{label}{half}")
    counted = spelled.groupBy("code").agg(*(cell(label, half) for label in (0, 1) for half in (0, 1))).toArrow()
    codes = counted["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    n = np.array([[counted[f"n{label}{half}"].to_numpy()[order] for half in (0, 1)] for label in (0, 1)])
    return [Models(alphabet, codes[order], x) for x in (n[:, 0], n[:, 1], n.sum(1))]


def fit_sample(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, folds: int, held: int, per_class: int) -> Scorer:
    """Fits models and the logistic fit to whole documents; the latter sees each document through models of the other half."""
    spark = ready(df)
    ids, counts = sample_of(labels, label_id, label_col, folds, held, per_class)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len({r["label"] for r in ids}) < 2:
        return Scorer(None, 0.0, 0.0, share)
    sample = table(sampled_texts(df, id_col, text_col, labels, label_id, ids), "toxicity-sample")
    *halves, whole = models_of(sample)
    shared = spark.sparkContext.broadcast(halves)
    schema = pa.schema([("label", pa.int32()), ("x", pa.float64())])

    def look(batches):
        readers = [m.reader() for m in shared.value]
        for b in batches:
            rows = [(label, readers[1 - half]([text])[0]) for label, half, text in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    got = sorted(tuple(r) for r in sample.select("_label", "_half", "text").mapInArrow(look, "label int, x double").collect())  # a row for each sampled id
    y, x = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return Scorer(None, 0.0, 0.0, share)
    return Scorer(whole, *calibrated(x, y, share), share)


def score_toxicity(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str = "doc_id", label_col: str = "toxic", *, folds: int = 4, held: int = 2, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row of df: id_col, held_out, score (probability of label 1), predicted (1 from THRESHOLD).

    Learns from labelled rows whose crc32 of the id modulo folds is not held,
    at most per_class of each label.  Null and empty texts have no words and
    a score of their own, that of no evidence.  Labels other than 0 and 1 and
    null ids of labels are not used; an id labelled twice has its larger label;
    of rows of df that repeat a labelled id, the fit sees the text of the least
    hash.  With labels of one class only, or none, all scores are the share of
    label 1, or 0.5.  Null and repeated ids stay, a row each.
    """
    scorer = fit_sample(df, id_col, text_col, labels, label_id, label_col, folds, held, per_class)
    shared = df.sparkSession.sparkContext.broadcast(scorer)  # the spellings of the sampled documents bound it

    def make():
        read = shared.value.reader()
        return lambda part: [read(part)]

    scored = map_texts(df, id_col, text_col, [("score", pa.float64())], make)
    return scored.select(id_col, (fold_of(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
