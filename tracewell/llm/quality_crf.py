"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  A line's features are its own, those of the lines
before and after it, and what both are to each other; transitions between
labels are learned as well.  A document's quality is the mean of its lines'
marginal probabilities of good, weighted by length, turned into a probability by
a logistic fit.

Only documents are labelled, their lines aren't: line labels are latent.  Lines
are first judged by themselves.  From there the fit goes by expectation and
maximisation: chains of those judgments and the learned transitions say what
lines are, bent as little as a document's label demands (of a good one most is
good, of a bad one half is bad), and the field moves towards that.  A plain line
beside junk thus stays plain.

The fit is to a bounded sample of labelled documents, each with all its lines.
They stay on the executors: every round is a pass over them that sums
statistics, and the driver holds the field's weights and these sums alone.
Scoring is one scan.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts, ready, table
from .labelled import calibrated, sample_of, sampled_texts

#: Labelled documents of each class that the fit sees at most.
SAMPLE_PER_CLASS = 800
THRESHOLD = 0.3
#: Passes that start the weights from the documents' labels, and passes that find the lines' own.
STARTS, ROUNDS = 5, 20
RIDGE = 3e-3
#: Lines whose features are held at once while a text is scored.
BLOCK = 4096
#: Good lines' share of the length of a document of label 1 at least, and of label 0 at most, while fitting.
GOOD_LEAST, GOOD_MOST = 0.8, 0.5

_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_LETTER = _UPPER + _UPPER.lower() + bytes(range(0xC0, 0x100))
_CONT = bytes(range(0x80, 0xC0))
_SYMBOL = b"#$%&*@^~<>{}[]\\|_=+`/"
_UPPER_TWO = tuple("ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒ")

FEATURES = ("words", "letters", "upper", "digits", "symbols", "bars", "bangs", "repeats", "distinct", "long", "stops", "again", "empty", "marked")


def feature_blocks(text: str):
    """(lines by FEATURES, code points of each line) of a text, BLOCK lines at a time; an empty text is one empty line."""
    lines = text.split("\n")
    seen = Counter(lines)
    for start in range(0, len(lines), BLOCK):
        rows, sizes = [], []
        for line in lines[start : start + BLOCK]:
            raw = line.encode("utf-8", "surrogatepass")
            flat = raw.translate(None, _CONT)  # one byte a code point
            n, words = len(flat), line.split()
            count = len(words)
            letters = n - len(flat.translate(None, _LETTER))
            upper = n - len(flat.translate(None, _UPPER))
            if len(raw) > n:
                upper += sum(map(line.count, _UPPER_TWO))
            repeats = sum(map(str.__eq__, words, words[1:]))
            distinct = len(set(words))
            marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?\"')")
            chars, pieces = max(n, 1), max(count, 1)
            rows.append((
                math.log1p(count), letters / chars, upper / max(letters, 1), (n - len(flat.translate(None, _DIGIT))) / chars,
                (n - len(flat.translate(None, _SYMBOL))) / chars, flat.count(b"|") / pieces, flat.count(b"!") / pieces, repeats / pieces,
                distinct / pieces, min(n / pieces, 40) / 10, line.rstrip().endswith((".", "?", "!", ":")), seen[line] > 1, count == 0, marked / pieces,
            ))
            sizes.append(n)
        yield np.array(rows, np.float64), np.array(sizes, np.float64)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """feature_blocks() of all lines."""
    rows, sizes = zip(*feature_blocks(text))
    return np.concatenate(rows), np.concatenate(sizes)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, the neighbours' (zero beyond the ends), the differences, and 1."""
    zero = np.zeros((1, x.shape[1]))
    before, after = np.concatenate([zero, x[:-1]]), np.concatenate([x[1:], zero])
    return np.concatenate([x, before, after, np.abs(x - before), np.ones((len(x), 1))], axis=1)


@dataclass
class Field:
    """Weights of good against bad per feature (of standardised features), transition scores from label to label, and the logistic fit of documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def unaries(self, blocks) -> np.ndarray:
        """The score of good of each line, of features that come block by block: neighbours are made for one block at a time."""
        zero, out = np.zeros((1, len(FEATURES))), []

        def put(before: np.ndarray, x: np.ndarray, after: np.ndarray) -> None:
            rows = with_neighbours(np.concatenate([before, x, after]))[1:-1]
            rows -= self.mean
            rows /= self.scale
            out.append(rows @ self.weights)

        before, held = zero, None
        for x in blocks:
            if held is not None:
                put(before, held, x[:1])
                before = held[-1:]
            held = x
        put(before, held, zero)
        return np.concatenate(out)

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Per line, the probability of good by forward-backward."""
        return chain(self.unaries(x[k : k + BLOCK] for k in range(0, len(x), BLOCK)), self.moves)[0]

    def quality_of(self, x: np.ndarray, sizes: np.ndarray) -> float:
        return self._share(self.marginals(x), sizes)

    @staticmethod
    def _share(good: np.ndarray, sizes: np.ndarray) -> float:
        weights = np.maximum(sizes, 1e-9)
        return float(good @ weights / weights.sum())

    @staticmethod
    def logit(quality: float) -> float:
        q = min(max(quality, 1e-6), 1 - 1e-6)
        return math.log(q / (1 - q))

    def score(self, text: str) -> float:
        sizes: list[np.ndarray] = []

        def blocks():
            for x, n in feature_blocks(text):
                sizes.append(n)
                yield x

        good = chain(self.unaries(blocks()), self.moves)[0]
        z = self.slope * self.logit(self._share(good, np.concatenate(sizes))) + self.offset
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def chain(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, expected moves (2 by 2) and the log of the sum over labellings; unary is the score of good, that of bad is 0."""
    n = len(unary)
    (m00, m01), (m10, m11) = np.exp(moves).tolist()
    shift = np.maximum(unary, 0)
    # Arrays, not lists: eight bytes a line each.
    good, bad = array("d", np.exp(unary - shift).tobytes()), array("d", np.exp(-shift).tobytes())
    f0, f1, norms = (array("d", bytes(8 * n)) for _ in range(3))
    a, b = bad[0], good[0]
    for i in range(n):
        if i:
            a, b = (f0[i - 1] * m00 + f1[i - 1] * m10) * bad[i], (f0[i - 1] * m01 + f1[i - 1] * m11) * good[i]
        norms[i] = s = a + b
        f0[i], f1[i] = a / s, b / s
    out, expected = array("d", bytes(8 * n)), np.zeros((2, 2))
    out[n - 1] = f1[n - 1]
    c = d = 1.0  # backward
    e00 = e01 = e10 = e11 = 0.0
    for i in range(n - 1, 0, -1):
        x0, x1, s = bad[i] * c / norms[i], good[i] * d / norms[i], norms[i]
        e00 += f0[i - 1] * m00 * x0
        e01 += f0[i - 1] * m01 * x1
        e10 += f1[i - 1] * m10 * x0
        e11 += f1[i - 1] * m11 * x1
        c, d = m00 * x0 + m01 * x1, m10 * x0 + m11 * x1
        out[i - 1] = f1[i - 1] * d
    expected[:] = [[e00, e01], [e10, e11]]
    return np.array(out), expected, float(np.sum(np.log(norms)) + shift.sum())


def told(unary: np.ndarray, moves: np.ndarray, sizes: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected moves of a document's lines, bent by the least tilt that gives the share of good its label demands."""
    weights = np.maximum(sizes, 1e-9) / np.maximum(sizes, 1e-9).sum()
    sign = 1.0 if label else -1.0

    def bent(tilt: float):
        good, expected, _ = chain(unary + sign * tilt, moves)
        share = float(good @ weights)
        return good, expected, share >= GOOD_LEAST if label else share <= GOOD_MOST

    good, expected, holds = bent(0.0)
    if holds:
        return good, expected
    low, high = 0.0, 1.0
    while not bent(high)[2] and high < 64:
        low, high = high, 2 * high
    for _ in range(8):
        middle = (low + high) / 2
        low, high = (low, middle) if bent(middle)[2] else (middle, high)
    return bent(high)[:2]


def moments(documents, _) -> np.ndarray:
    """Sums of lines, features and squared features."""
    out = np.zeros((3, 4 * len(FEATURES) + 1))
    for x, _, _ in documents:
        rows = with_neighbours(x)
        out += np.stack([np.full(rows.shape[1], len(rows)), rows.sum(0), (rows**2).sum(0)])
    return out


def start_sums(documents, state) -> np.ndarray:
    """Gradient and Hessian (last rows) of the logistic loss of lines that have their document's label; documents of a class weigh the same."""
    mean, scale, of_class, w = state
    out = np.zeros((len(w) + 2, len(w)))
    for x, _, y in documents:
        rows = (with_neighbours(x) - mean) / scale
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        own = of_class[y] / len(rows)
        out[0] += own * (rows.T @ (p - y))
        out[1] += own * (rows**2).sum(0)
        out[2:] += own * (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows
    return out


def line_sums(documents, state) -> np.ndarray:
    """Gradients of weights and (last row) moves towards what the latent labels are, by expectation."""
    mean, scale, of_class, start, w, moves = state
    out = np.zeros((2, len(w)))
    for x, sizes, y in documents:
        rows = (with_neighbours(x) - mean) / scale
        own = of_class[y] / len(rows)
        free, free_moves, _ = chain(rows @ w, moves)
        good, good_moves = told(rows @ start, moves, sizes, y)
        out[0] += own * (rows.T @ (good - free))
        out[1, :4] += own * (good_moves - free_moves).ravel()
    return out


def fit(summed, counts: dict[int, int], share_good: float) -> Field:
    """A field for documents that summed(function, state) passes over, adding up what the function gives for parts of them.

    counts: documents of each label; share_good: of label 1 among all labels.
    """
    width = 4 * len(FEATURES) + 1
    if not counts.get(0) or not counts.get(1):
        return Field(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, math.log((share_good + 1e-3) / (1 - share_good + 1e-3)))
    lines, first, second = summed(moments, None)
    mean, scale = first / lines, np.sqrt(np.maximum(second / lines - (first / lines) ** 2, 0))
    mean[-1], scale[scale < 1e-6] = 0.0, 1.0
    of_class = {y: 1 / (2 * counts[y]) for y in (0, 1)}  # each document weighs the same, and so does each class
    # The start looks at lines by themselves: a plain line beside junk is plain.
    w, own = np.zeros(width), np.array([*range(len(FEATURES)), width - 1])
    for _ in range(STARTS):
        gradient, squares, *hessian = summed(start_sums, (mean, scale, of_class, w))
        w[own] -= np.linalg.solve(np.array(hessian)[np.ix_(own, own)] + (RIDGE + 1e-9) * np.eye(len(own)), (gradient + RIDGE * w)[own])
    spread = np.sqrt(squares) + 1e-3
    start, moves = w.copy(), np.zeros((2, 2))
    momentum_w, momentum_m = np.zeros(width), np.zeros((2, 2))
    for _ in range(ROUNDS):
        gw, gm = summed(line_sums, (mean, scale, of_class, start, w, moves))
        momentum_w = 0.7 * momentum_w + (gw - RIDGE * w) / spread
        momentum_m = 0.7 * momentum_m + gm[:4].reshape(2, 2) - RIDGE * moves
        w, moves = w + 0.5 * momentum_w, moves + 0.5 * momentum_m
    return Field(mean, scale, w, moves)


def unpacked(labels, features, sizes):
    """(features, sizes, label) of documents from their bytes."""
    for y, x, s in zip(labels.to_pylist(), features.to_pylist(), sizes.to_pylist()):
        yield np.frombuffer(x, "<f4").reshape(-1, len(FEATURES)).astype(float), np.frombuffer(s, "<f4").astype(float), y


def fit_sample(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, folds: int, held: int, per_class: int) -> Field:
    """Fits a field to all lines of the sampled documents, in passes over them on the executors."""
    ready(df)
    ids, counts = sample_of(labels, label_id, label_col, folds, held, per_class)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if not ids:
        return fit(None, {}, share)
    schema = pa.schema([("label", pa.int32()), ("features", pa.binary()), ("sizes", pa.binary())])

    def features(batches):
        for b in batches:
            out = [(label, *(a.astype("<f4").tobytes() for a in line_features(text))) for label, text in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    found = sampled_texts(df, id_col, text_col, labels, label_id, ids).select("_label", "text")
    sample = table(found.mapInArrow(features, "label int, features binary, sizes binary"), "quality-sample")

    def summed(function, state) -> np.ndarray:
        def run(batches):
            total = None
            for b in batches:
                own = function(unpacked(*b.columns), state)
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([len(total)], pa.int32())], ["sums", "rows"])

        parts = sorted((r["sums"], r["rows"]) for r in sample.mapInArrow(run, "sums binary, rows int").collect())  # a row for each file of the sample
        return sum(np.frombuffer(s, np.float64).reshape(n, -1) for s, n in parts)

    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    field = fit(summed, seen, share)
    if not seen.get(0) or not seen.get(1):
        return field
    pairs = pa.schema([("label", pa.int32()), ("quality", pa.float64())])

    def qualities(batches):
        for b in batches:
            out = [(y, field.quality_of(x, s)) for x, s, y in unpacked(*b.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), pairs)] if out else [pa.array([], f.type) for f in pairs], schema=pairs)

    got = sorted(tuple(r) for r in sample.mapInArrow(qualities, "label int, quality double").collect())  # a row for each sampled id
    logit = np.array([field.logit(q) for _, q in got])
    field.slope, field.offset = calibrated(logit, np.array([y for y, _ in got]), share)
    return field


def score_quality(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", *, folds: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row of df: id_col, held_out, score (probability of label 1), predicted (1 from THRESHOLD).

    Learns from labelled rows whose crc32 of the id modulo folds is not held,
    at most per_class of each label.  Null and empty texts are one empty line.
    Labels other than 0 and 1 and null ids of labels are not used; an id
    labelled twice has its larger label; of rows of df that repeat a labelled
    id, the fit sees the text of the least hash.  With labels of one class only,
    or none, all scores are the share of label 1, or 0.5.  Null and repeated ids
    stay, a row each.
    """
    field = fit_sample(df, id_col, text_col, labels, label_id, label_col, folds, held, per_class)

    def make():
        return lambda part: [[field.score(t) for t in part]]

    scored = map_texts(df, id_col, text_col, [("score", pa.float64())], make)
    return scored.select(id_col, (fold_of(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", *, folds: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of df that score_quality() predicts as 1, with df's own columns."""
    field = fit_sample(df, id_col, text_col, labels, label_id, label_col, folds, held, per_class)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array([field.score(t or "") for t in text.to_pylist()], pa.float64())

    return df.filter(score(F.col(text_col)) >= THRESHOLD)


def good_lines(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", *, folds: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """id_col and goods, the probability of good of each line of the text in order (an empty text is one line): a row per row of df."""
    field = fit_sample(df, id_col, text_col, labels, label_id, label_col, folds, held, per_class)

    def make():
        return lambda part: [[field.marginals(line_features(t)[0]).tolist() for t in part]]

    return map_texts(df, id_col, text_col, [("goods", pa.list_(pa.float64()))], make)
