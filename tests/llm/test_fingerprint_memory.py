"""Trees of long texts: bounded memory, the same in blocks of any size."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tracewell.llm import merkle

from .cases import ROWS, documents


@pytest.mark.parametrize("block, at_once", [(16, 40), (1000, 7)])
def test_blocks(monkeypatch, block, at_once):
    rng = np.random.default_rng(31)
    pieces = ["\n", " ", "\n\n", "word ", "x" * 150, "é", "one two three "]
    texts = ["".join(rng.choice(pieces, int(n))).encode() for n in (0, 1, 3, 50, 400, 900)]
    texts += [texts[-1][:900] + b"an edit" + texts[-1][900:], b"\n" * 300]
    seen = lambda: [(t.digest, t.size, merkle.likeness(t, o), merkle.first_difference(t, o)) for t in map(merkle.tree, texts) for o in map(merkle.tree, texts)]
    want = seen()
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "SORTED", at_once)
    monkeypatch.setattr(merkle, "FEW", 0)
    assert seen() == want


@pytest.mark.parametrize("text, factor", [("'some words of a long line ' * 300_000", 30), ("'\\n' * 500_000", 450)])
def test_memory_of_a_long_text(text, factor):
    """Two trees of a long text and its comparison take a bounded multiple of the text above the start."""
    code = f"""
import resource, sys
sys.path.insert(0, sys.argv[1])
from tracewell.llm import merkle
text = {text}
other = merkle.edited(text, text[::-1])
merkle.compare(text[:1000], merkle.tree(text[:1000].encode()), other[:1000], merkle.tree(other[:1000].encode()))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
merkle.compare(text, merkle.tree(text.encode()), other, merkle.tree(other.encode()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text))
"""
    root = str(Path(merkle.__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=300, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert done.stdout and float(done.stdout) < factor, done.stdout + done.stderr[-1000:]


def test_names_that_clash(spark):
    rows = documents(spark, ROWS[:2]).withColumnRenamed("doc_id", "n_chars")
    with pytest.raises(ValueError, match="n_chars"):
        merkle.fingerprint_documents(rows, "n_chars", "text")
