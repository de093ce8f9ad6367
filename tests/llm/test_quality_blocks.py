"""The quality field on very long texts, block by block, and its gradients against finite differences."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tracewell.llm import quality_crf


def a_field(seed=1):
    rng = np.random.default_rng(seed)
    width = 4 * len(quality_crf.FEATURES) + 1
    return quality_crf.Field(rng.normal(size=width), rng.uniform(0.5, 2, width), rng.normal(size=width) / 5, rng.normal(size=(2, 2)), 0.7, 0.1)


def texts(rng):
    words = ["Plain", "words", "!!!", "| bar |", "ÜBER", "7", "", "x" * 40, "a.", "again"]
    return ["", "\n", "one line", "\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(100))] + ["\n".join(" ".join(rng.choice(words, 3)) for _ in range(n)) for n in (1, 2, 7, 8, 9, 16, 17)]


@pytest.mark.parametrize("block", [1, 2, 8, 1000])
def test_blocks_of_lines(monkeypatch, block):
    monkeypatch.setattr(quality_crf, "BLOCK", block)
    field = a_field()
    for text in texts(np.random.default_rng(2)):
        x, sizes = quality_crf.line_features(text)
        unary = ((quality_crf.with_neighbours(x) - field.mean) / field.scale) @ field.weights
        assert np.allclose(field.marginals(x), quality_crf.chain(unary, field.moves)[0], atol=1e-12)
        good = quality_crf.chain(unary, field.moves)[0] @ np.maximum(sizes, 1e-9) / np.maximum(sizes, 1e-9).sum()
        assert np.isclose(field.quality_of(x, sizes), good, atol=1e-12)
        assert np.isclose(field.score(text), 1 / (1 + np.exp(-np.clip(field.slope * field.logit(good) + field.offset, -30, 30))), atol=1e-12)


def test_memory_of_a_long_text():
    """A million lines take a small multiple of their text, not a thousand bytes each."""
    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from tracewell.llm import quality_crf
width = 4 * len(quality_crf.FEATURES) + 1
field = quality_crf.Field(np.zeros(width), np.ones(width), np.ones(width) / 50, np.zeros((2, 2)))
field.score("a line\\n" * 100)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
field.score("\\n" * 1_000_000)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = str(Path(quality_crf.__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=300, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert done.stdout and int(done.stdout) < 250, done.stdout + done.stderr[-1000:]


def test_gradients():
    """line_sums() is the gradient of the expected score of what lines are told to be, less the log of the sum over labellings."""
    rng = np.random.default_rng(5)
    field, start = a_field(3), rng.normal(size=4 * len(quality_crf.FEATURES) + 1) / 5
    documents = [(*quality_crf.line_features(t), y) for t, y in zip(texts(rng)[3:8], (1, 0, 1, 0, 1))]
    of_class = {0: 0.25, 1: 0.5}

    def objective(w, moves):
        total = 0.0
        for x, sizes, y in documents:
            rows = (quality_crf.with_neighbours(x) - field.mean) / field.scale
            good, expected = quality_crf.told(rows @ start, field.moves, sizes, y)
            total += of_class[y] / len(rows) * (good @ (rows @ w) + (expected * moves).sum() - quality_crf.chain(rows @ w, moves)[2])
        return total

    got = quality_crf.line_sums(documents, (field.mean, field.scale, of_class, start, field.weights, field.moves))
    step = 1e-5
    for k in range(len(field.weights)):
        e = np.zeros_like(field.weights)
        e[k] = step
        assert np.isclose(got[0, k], (objective(field.weights + e, field.moves) - objective(field.weights - e, field.moves)) / (2 * step), atol=1e-6)
    for k in range(4):
        e = np.zeros(4)
        e[k] = step
        e = e.reshape(2, 2)
        assert np.isclose(got[1, k], (objective(field.weights, field.moves + e) - objective(field.weights, field.moves - e)) / (2 * step), atol=1e-6)
