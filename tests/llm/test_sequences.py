"""Repair of conversations, shards and periodic runs: against brute force and SQL, with the cases every operator must handle."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import conversation_repair, periodic_runs, queries, sharding

from .cases import ROWS, documents, empty

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_sharding"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "conversations"):
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    want = connection.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


# ---- conversations


def fault_of(text, role, seen):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"


def cheapest(turns):
    """(cost, audit, repaired text) by trying every edit with up to two inserts at each place."""
    found = []
    spaces = [["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]] * (len(turns) + 1)
    for edits in itertools.product(["K", "U", "A", "D"], repeat=len(turns)):
        if any(f in ("blank", "duplicate") and e != "D" for e, (_, _, f) in zip(edits, turns)):
            continue
        for inserts in itertools.product(*spaces):
            cost, audit, lines = 0, "", []
            for k in range(len(turns) + 1):
                for x in inserts[k]:
                    cost, audit = cost + 5, audit + "I"
                    lines.append(("user" if x == "u" else "assistant", ""))
                if k < len(turns):
                    role, text, fault = turns[k]
                    e = edits[k]
                    cost += {"K": 0, "D": 2}.get(e, 1) + (5 if fault == "truncated" and e != "D" else 0)
                    audit += {"K": "K", "D": "D"}.get(e, "R")
                    if e != "D":
                        lines.append(({"K": role, "U": "user", "A": "assistant"}[e], text))
            if all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines)):
                found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)))
    return min(found)


def expected(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        turns.append((role, text, fault_of(text, role, seen)))
        seen.add((role, text))
    known = {t for t, _, _ in rows if t is not None}
    faults = Counter(f for _, _, f in turns)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, text = cheapest(turns)
    return (max(known) - min(known) + 1 - len(known) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), text


NAMES = ("conv_id", "turn", "role", "text")


def test_repair_by_brute_force(spark):
    rng, rows, want, texts = np.random.default_rng(4), [], {}, {}
    for c in range(60):
        own = []
        for k in range(int(rng.integers(1, 4))):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 5))
            own.append((turn, str(rng.choice(["user", "assistant", "system", "tool", "", "u"])), str(rng.choice(["Yes.", "No", " \n", "Well! ", "Yes."]))))
        if c % 5 == 0:
            own.append(own[0])
        want[c], texts[c] = expected(own)
        rows += [(c, *r) for r in own]
    rows += [(None, None, None, None), (None, 3, "user", "Ünïcödé 漢字."), (100, 1, "assistant", "long " * 50_000 + ".")]
    want[None], texts[None] = expected([(None, None, None), (3, "user", "Ünïcödé 漢字.")])
    want[100], texts[100] = expected([(1, "assistant", "long " * 50_000 + ".")])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, _conv int, audit string")
    report = conversation_repair.repair_conversations(df, *NAMES)
    assert {r[0]: tuple(r)[1:] for r in report.collect()} == want
    turns = defaultdict(list)
    for r in conversation_repair.repaired_turns(df, report, *NAMES).collect():
        turns[r["conv_id"]].append((r["position"], f"{r['role']}:{r['text']}"))
    assert {c: "\n".join(t for _, t in sorted(x)) for c, x in turns.items()} == {c: t for c, t in texts.items() if t}
    assert all([p for p, _ in sorted(x)] == list(range(len(x))) for x in turns.values())


def test_ties_of_long_conversations():
    """Whole audit strings, carried turn by turn in a plain forward pass, against the ranks."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        turns = [(str(rng.choice(["user", "assistant", "system"], p=[0.5, 0.4, 0.1])), str(rng.choice(["", "", "truncated", "blank"]))) for _ in range(int(rng.integers(5, 40)))]
        walk, plain = conversation_repair.Walk(), {0: (0, "")}

        def closed(states):
            for _ in range(3):
                for s, (cost, audit) in list(states.items()):
                    to = conversation_repair.NEXT[s][0]
                    states[to] = min(states.get(to, (1e9, "")), (cost + 5, audit + "I"))
            return states

        for role, fault in turns:
            walk.add(None, role, b"", fault)
            new = {}
            for s, (cost, audit) in closed(dict(plain)).items():
                fee = 5 if fault == "truncated" else 0
                options = [(s, cost + 2, "D")]
                if fault != "blank":
                    options.append((conversation_repair.NEXT[s][0], cost + 1 + fee, "R"))
                    if s in conversation_repair.GRAMMAR[role[0]]:
                        options.append((conversation_repair.GRAMMAR[role[0]][s], cost + fee, "K"))
                for to, c, x in options:
                    new[to] = min(new.get(to, (1e9, "")), (c, audit + x))
            plain = new
        best = min(v for s, v in closed(plain).items() if s in conversation_repair.FINAL)
        assert (walk.result()[5], walk.result()[6]) == best


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text {c}. And {t}?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = Counter(map(tuple, conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), *NAMES).collect()))
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[(c, t, "user" if kind == 4 else role, text, kind == 0)] += 2 if kind == 3 else 1
    assert got == want


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello.", True), (2, 0, "user", "Hello.", False)], "conv_id long, turn long, role string, text string, off boolean")
    nothing = hashlib.sha256().hexdigest()
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_conversations(df, *NAMES, gone_col="off").collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", nothing), 2: (0, 0, 0, 0, 0, 2, "D", nothing)}
    assert conversation_repair.repair_conversations(df.limit(0), *NAMES).count() == 0
    with pytest.raises(ValueError):
        conversation_repair.repair_conversations(df.withColumnRenamed("conv_id", "audit"), "audit", "turn", "role", "text")


# ---- shards


def sharded(rows, shards, seed=1):
    by_source = defaultdict(list)
    for i, text, _, source in rows:
        data = (text or "").encode()
        by_source["" if source is None else f"={source}"].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, len(data) + 1, zlib.crc32(data)))
    line = []
    for source, own in by_source.items():
        for r, (_, there, i, size, crc) in enumerate(sorted(own)):
            line.append(((2 * r + 1) / (2 * len(own)), source, i if there else None, size, crc))
    line.sort(key=lambda x: x[:2])
    firsts = [-(-s * len(rows) // shards) for s in range(shards + 1)]
    return sorted(str((i, size, crc, "rows", place * shards // len(rows), place - firsts[place * shards // len(rows)], None, place)) for place, (_, _, i, size, crc) in enumerate(line))


@pytest.mark.parametrize(("rows", "bins"), [(ROWS, 20_000), (ROWS, 2), ([(i % 700, f"text {i % 900}", "en", "ab"[i % 3 == 0] if i % 50 else f"s{i}") for i in range(3000)], 100), ([(7, "the same row", "en", "a")] * 1500 + [(i, "other", "en", "b") for i in range(500)], 64)])
def test_shards(spark, monkeypatch, rows, bins):
    monkeypatch.setattr(sharding, "BIN_ROWS", bins)
    monkeypatch.setattr(sharding, "REPEATS", 128)
    got = sharding.shard_documents(documents(spark, rows).repartition(5), "doc_id", "text", "source").collect()
    assert sorted(str(tuple(r)) for r in got) == sharded(rows, 16)
    counts = Counter(r["shard"] for r in got)
    assert len(rows) < 16 or max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "a" if i % 3 else "b" if i % 2 else "c") for i in range(4000)]
    got = sharding.shard_documents(documents(spark, rows), "doc_id", "text", "source", 7)
    shares, source = Counter(r[3] for r in rows), {r[0]: r[3] for r in rows}
    for (_, s), n in Counter((r["shard"], source[r["doc_id"]]) for r in got.collect()).items():
        assert abs(n - shares[s] / 7) <= 2


def test_written_shards(spark, tmp_path):
    rows = [(i % 40, f"text {i % 4}", "en", "ab"[i % 3 == 0]) for i in range(400)]
    df = documents(spark, rows).withColumn("own", F.col("doc_id") * 2)
    sharding.write_shards(df, "doc_id", "text", "source", f"file://{tmp_path}/out", 4)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, map(tuple, got.select(df.columns).collect()))) == sorted(map(str, map(tuple, df.collect())))
    slots = defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    assert {k: sorted(v) for k, v in slots.items()} == {k: list(range(100)) for k in range(4)}


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(empty(spark), "doc_id", "text", "source").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(documents(spark).withColumnRenamed("doc_id", "slot"), "slot", "text", "source")


# ---- periodic runs


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                own = words[i : i + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_answer(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) if plant else 1
    if h % 10 == 0 and words:
        a, g = (h // 10) % len(words), h // 10
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    first = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    top = [*first[0], 1000 * first[0][1] // first[0][2]] if first else [None] * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_rows():
    rng, rows = np.random.default_rng(3), [r for r in ROWS if r[1] is None or len(r[1]) < 10_000]
    for i in range(20, 260):
        words = [f"w{x}" for x in rng.integers(0, int(rng.integers(1, 30)), int(rng.integers(0, 150)))]
        if i % 3 == 0 and len(words) > 20:
            k = int(rng.integers(1, 12))
            words[8:] = [words[8 + x % k] for x in range(len(words) - 8)]
        rows.append((i, "\x0b".join(words) if i % 2 else "  ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("plant", [True, False])
def test_runs_by_brute_force(spark, plant):
    rows = run_rows()
    got = periodic_runs.periodic_runs(documents(spark, rows), "doc_id", "text", plant).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(runs_answer(i, t, plant)) for i, t, *_ in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 50


@pytest.mark.parametrize("heavy_from", [0, 1, 3, 1000, None])
def test_lag_counts(heavy_from, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 500)
    rng = np.random.default_rng(6)
    for n in (12, 100, 1000):
        codes = (rng.zipf(1.4, n) % 50).astype(np.int32)
        codes = np.unique(codes, return_inverse=True)[1].astype(np.int32)
        assert periodic_runs.lag_counts(codes, n // 2, heavy_from)[1:].tolist() == [int((codes[q:] == codes[:-q]).sum()) for q in range(1, n // 2 + 1)]


def test_long_texts_and_blocks(monkeypatch):
    text = ("long words and more words, " * 100_000).encode()
    codes, words = periodic_runs.words_of(text)
    assert periodic_runs.find_runs(codes) == [(0, 500_000, 5)]
    assert b" ".join(words[c] for c in periodic_runs.collapsed(codes, [(0, 500_000, 5)])) == b"long words and more words,"
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    codes, words = periodic_runs.words_of(b"\t a bb  ccc\xc2\xa0d\nbb abcdefghijklmn \xff ")
    assert [words[c] for c in codes] == [b"a", b"bb", b"ccc\xc2\xa0d", b"bb", b"abcdefghijklmn", b"\xff"]


def test_collapse(spark):
    rows = [(1, "a b c " * 9 + "d", "en", "a"), (2, None, "en", "a")]
    got = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in periodic_runs.collapse_runs(documents(spark, rows), "doc_id", "text").collect()}
    assert [tuple(r) for r in got[1][0]] == [(0, 27, 3)] and got[1][1] == "a b c d" and got[2] == ([], "")


def test_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(empty(spark), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(documents(spark).withColumnRenamed("doc_id", "start"), "start", "text")
