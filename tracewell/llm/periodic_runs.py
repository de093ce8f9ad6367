"""Runs of words that repeat with a period, found by counting lags.

A run is a stretch of consecutive words with smallest period q and at least
max(12, 2q) words that no neighbouring word extends.  Words that are q apart
and equal are matches at lag q, and a run of period q is an island of at least
max(q, 12 - q) consecutive matches.  So each lag's matches are counted first:
words are heavy or light by their frequency, pairs of equal light words are
counted by their differences, and heavy words by an autocorrelation of their
places (FFT, rounded to whole numbers, which it is exact for).  Only lags with
enough matches for an island are scanned, and a scan looks at blocks of which
every island holds one: of n words it touches about n/q at lag q.

Lags are scanned in ascending order.  A stretch of period q and 2q words or
more whose smallest period is less has one that divides q, and its run is known
by then: places inside it are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import arrow_schema, batch, ready

#: Words of a run at least.
LEAST = 12
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
#: Pairs of light words, and places of heavy words' transforms, that are held at once.
PAIRS = 1 << 20
#: Places of a block that are compared before a whole island is.
PROBES = 6

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the distinct words by number; the text is split block by block."""
    known: dict[bytes, int] = {}
    codes, at = array("i"), 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        codes.extend([known.setdefault(w, len(known)) for w in text[at:end].split()])
        at = end
    return np.frombuffer(codes, np.int32) if codes else np.zeros(0, np.int32), list(known)


def planted(codes: np.ndarray, h: int) -> np.ndarray:
    """The words with a planted repetition where h ends in 0: from a on, words a to a + p - 1 again and again."""
    n, g = len(codes), h // 10
    if h % 10 or not n:
        return codes
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % p]])


def _fft_size(least: int) -> int:
    size = 1 << (least - 1).bit_length()
    return size * 3 // 4 if size * 3 // 4 >= least else size


def lag_counts(codes: np.ndarray, half: int, heavy_from: int | None = None) -> np.ndarray:
    """How many words equal the word q later, for each q from 1 up to half; words of more than heavy_from places go through the FFT."""
    n = len(codes)
    size = _fft_size(n + half + 1)
    if heavy_from is None:
        heavy_from = int((size * size.bit_length() / 3) ** 0.5)
    frequency = np.bincount(codes)
    order = np.argsort(codes, kind="stable")
    light = order[frequency[codes[order]] <= heavy_from]
    counts = np.zeros(half + 1, np.int64)
    if len(light):
        # For each place, how many later places have its word.
        own = codes[light]
        ends = np.searchsorted(own, own, side="right")
        later = ends - np.arange(len(own)) - 1
        total = np.cumsum(later)
        start = 0
        while start < len(own):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
            many = later[start:stop]
            left = np.repeat(np.arange(start, stop), many)
            steps = np.arange(len(left)) - np.repeat(total[start:stop] - many - base, many)
            apart = light[left + 1 + steps] - light[left]
            counts += np.bincount(apart[apart <= half], minlength=half + 1)
            start = stop
    heavy = np.flatnonzero(frequency > heavy_from)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        at_once = max(1, PAIRS // size)
        for k in range(0, len(heavy), at_once):
            places = np.zeros((len(heavy[k : k + at_once]), size))
            places[:, :n] = codes == heavy[k : k + at_once, None]
            spectrum = np.fft.rfft(places)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, size)[: half + 1]).astype(np.int64)
    counts[0] = 0
    return counts


def _stops(codes: np.ndarray, q: int, i: int, way: int) -> int:
    """The first place from i on (way 1), or the last before i (way -1), whose word differs from that q later; the border where none does."""
    n, width = len(codes) - q, 64
    while True:
        if way > 0:
            end = min(n, i + width)
            differ = np.flatnonzero(codes[i:end] != codes[i + q : end + q])
            if len(differ) or end == n:
                return i + int(differ[0]) if len(differ) else n
            i = end
        else:
            begin = max(0, i - width)
            differ = np.flatnonzero(codes[begin:i] != codes[begin + q : i + q])
            if len(differ) or begin == 0:
                return begin + int(differ[-1]) if len(differ) else -1
            i = begin
        width *= 2


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period."""
    n, half = len(codes), len(codes) // 2
    if n < LEAST:
        return []
    counts = lag_counts(codes, half)
    lags = np.arange(half + 1)
    enough = np.maximum(lags, LEAST - lags)
    runs: list[tuple[int, int, int]] = []
    known: list[tuple[int, int, int, int]] = []  # next multiple of the period, start, end, period
    for q in np.flatnonzero(counts[1:] >= enough[1:]) + 1:
        q, need = int(q), int(enough[q])
        inside = []
        while known and known[0][0] <= q:
            _, start, end, period = heapq.heappop(known)
            following = -(-q // period) * period
            if following == q:
                inside.append((start, end))
                following += period
            if following <= end - start:
                heapq.heappush(known, (following, start, end, period))
        block = (need + 1) // 2
        at = np.arange(0, n - q - block + 1, block)
        for start, end in inside:
            at = at[(at < start) | (at + q > end)]
        for k in range(PROBES):
            if not len(at):
                break
            shifted = at + (block - 1) * k // (PROBES - 1)
            at = at[codes[shifted] == codes[shifted + q]]
        done = 0
        for i in at.tolist():
            if i < done:
                continue
            done = _stops(codes, q, i, 1)
            if done - i < block:
                continue
            first = _stops(codes, q, i, -1) + 1
            if done - first >= need and not any(start <= first and done + q <= end for start, end in inside):
                runs.append((first, done - first + q, q))
                if 2 * q <= done - first + q:
                    heapq.heappush(known, (2 * q, first, done + q, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(codes: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that stay: of each run, all after its first period go."""
    if not runs:
        return codes
    edges = np.zeros(len(codes) + 1, np.int32)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return codes[np.cumsum(edges[:-1]) == 0]


def _pieces(codes: np.ndarray, words: list[bytes]):
    """The words joined by one space, piece by piece."""
    for k in range(0, len(codes), 65_536):
        yield (b" " if k else b"") + b" ".join([words[c] for c in codes[k : k + 65_536].tolist()])


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def report(codes: np.ndarray, words: list[bytes]) -> tuple:
    runs = find_runs(codes)
    digest = hashlib.sha256()
    for piece in _pieces(collapsed(codes, runs), words):
        digest.update(piece)
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest()


def _walk(df: DataFrame, id_col: str, text_col: str, plant: bool, fields, make) -> DataFrame:
    ready(df)
    schema = arrow_schema(df, id_col, *fields)
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) if plant else F.lit(1).cast("long")
    rows = df.select(F.col(id_col), h.alias("_h"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            made = []
            for i in range(b.num_rows):
                codes, words = words_of(b.column(2)[i].as_py())
                made.append(make(planted(codes, b.column(1)[i].as_py()), words))
            yield batch(schema, b.column(0), *([m[k] for m in made] for k in range(len(fields))))

    return rows.mapInArrow(run, from_arrow_schema(schema))


def periodic_runs(df: DataFrame, id_col: str, text_col: str, plant: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    start, length, period and exponent_milli are those of the longest run (of
    these the first, then the one of the least period), null without runs.
    plant puts a repetition into texts by their ids first.  A null text is
    empty: it has no runs, and both hashes are those of nothing; a null id
    counts as the empty text for plant.  Each row is looked at by itself, so
    ties and repeated rows give equal rows.  An empty table gives an empty
    table; id_col can't have the name of a result.
    """
    return _walk(df, id_col, text_col, plant, _FIELDS, report)


def collapse_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of df: id_col, runs (start, length, period of each) and collapsed, the text with one period of each run, words joined by a space."""
    fields = [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]

    def make(codes, words):
        runs = find_runs(codes)
        return [dict(zip(("start", "length", "period"), r)) for r in runs], b"".join(_pieces(collapsed(codes, runs), words)).decode(errors="replace")

    return _walk(df, id_col, text_col, False, fields, make)
