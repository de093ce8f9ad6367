"""Transcripts from split files and main chains of records: against a parser that walks a file line by line."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import chains, ordered
from tracewell.sources import capture, datasets, transcripts


def walked(records):
    """uuids from the root to the last leaf of (uuid, parent, leaf) in order; None for a cycle, a lost parent or no leaf."""
    by_id = {u: p for u, p, _ in records if u is not None}
    own = [u for u, _, leaf in records if leaf and u is not None]
    at, seen = own[-1] if own else None, []
    if at is None:
        return None
    while at is not None:
        if at in seen or at not in by_id:
            return None
        seen.append(at)
        at = by_id[at]
    return seen[::-1]


def random_groups():
    rng = random.Random(3)
    groups = {"line": [(str(i), str(i - 1) if i else None, True) for i in range(1000)], "back": [(str(i), str(i + 1) if i < 299 else None, True) for i in range(300)][::-1] + [("0", "1", True)]}
    groups["zigzag"] = [(str(i), None if i == 0 else str(i - 1 if i % 2 else max(0, i - 3)), True) for i in range(500)]
    groups["loop"] = [(str(i), str((i + 1) % 70), True) for i in range(70)]
    groups["self"], groups["lost"], groups["leafless"] = [("0", "0", True)], [("1", "0", True), ("2", "1", True)], [("1", None, False)]
    groups["tail loop"] = [("a", "b", True), ("b", "a", True), ("c", None, True), ("d", "c", True)]
    for g in range(40):
        n = rng.randint(1, 60)
        rows = [(str(i), None if rng.random() < 0.05 else str(max(-1, i - rng.choice([1, 1, 1, 1, 2, 5]))) if rng.random() < 0.98 else str(rng.randint(0, n)), rng.random() < 0.7) for i in range(n)]
        rows += [(None, "0", True), rows[rng.randint(0, n - 1)]] if g % 3 == 0 else []
        groups[f"random {g}"] = rows
    return groups


@pytest.mark.parametrize("block", [1, 7, 5000])
def test_main_chains(spark, block):
    groups = random_groups()
    rows = [(g, i // block, i, u, p, leaf) for g, records in groups.items() for i, (u, p, leaf) in enumerate(records)]
    df = spark.createDataFrame(rows, "group string, block long, at long, uuid string, parent string, leaf boolean")
    got = {}
    for r in chains.in_order(df).collect():
        got.setdefault(r["group"], []).append((r["place"], r["uuid"], r["broken"]))
    for g, records in groups.items():
        want = walked(records)
        rows = sorted(got[g], key=lambda r: r[0])
        assert [r[0] for r in rows] == list(range(len(rows))), g
        assert [r[1] for r in rows] == (want if want is not None else [u for u, _, _ in records]), g
        assert {r[2] for r in rows} == {want is None}, g


def test_no_records(spark):
    df = spark.createDataFrame([], "group string, block long, at long, uuid string, parent string, leaf boolean")
    assert chains.in_order(df).count() == 0


def test_ordered(spark):
    rng = random.Random(5)
    rows = [(g, i // 6, i, rng.randint(0, 3)) for g, n in (("a", 100), (None, 40), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, block int, at int, v int").repartition(7)
    sums = ordered.running_sum(df, ["g"], "block", "at", F.col("v"), "sum")
    both = ordered.previous(sums, ["g"], "block", "at", F.col("v"), "prev").collect()
    assert len(both) == len(rows)
    for r in both:
        own = [v for g, _, at, v in rows if g == r["g"] and at <= r["at"]]
        assert r["sum"] == sum(own) and r["prev"] == (own[-2] if len(own) > 1 else None)


# ---- whole transcripts


def parsed(lines, name, options):
    """messages, usage, compactions and skipped of one file, line by line."""
    records, skipped = [], {}

    def skip(why):
        skipped[why] = skipped.get(why, 0) + 1

    for line in lines:
        if line.strip():
            try:
                records.append(json.loads(line))
            except ValueError:
                skip("parse_error")
    session = next((r["sessionId"] for r in records if r.get("sessionId")), name)
    fine = lambda r: options.sidechains or not r.get("isSidechain")
    for r in records:
        if r["type"] not in ("user", "assistant", "attachment"):
            skip(r["type"])
        elif not fine(r):
            skip("sidechain")
    light = [(r.get("uuid"), r.get("parentUuid"), r["type"] in ("user", "assistant") and fine(r)) for r in records]
    order = walked(light)
    if order is not None:
        by_id = {r["uuid"]: r for r in records if r.get("uuid")}
        chain = [by_id[u] for u in order]
    elif any(u and leaf for u, _, leaf in light):
        skip("orphan_chain")
        chain = [r for r in records if fine(r) and r["type"] in ("user", "assistant", "attachment")]
    else:
        chain = []
    messages, usage, compactions, pending, group = [], [], [], {}, None
    drafts = []
    for r in chain:
        if not fine(r) or r["type"] not in ("user", "assistant") and not (r["type"] == "attachment" and options.attachments):
            if r["type"] == "attachment" and not options.attachments:
                skip("attachment")
            group = None
            continue
        inner = r.get("message", {})
        key = ("a", inner.get("id")) if r["type"] == "assistant" else None
        if key is None or key != group:
            drafts.append({"role": "assistant" if key else "user", "texts": [], "thoughts": [], "uses": [], "results": [], "usage": None, "compact": r.get("isCompactSummary") is True})
        group, m = key, drafts[-1]
        m["usage"] = inner.get("usage")
        if r["type"] == "attachment":
            m["texts"].append("\n\n".join(x["content"] for x in r["rendered"]))
            continue
        content, own = inner.get("content"), []
        for b in [{"type": "text", "text": content}] if isinstance(content, str) else content or []:
            if b["type"] == "text":
                own.append(b["text"])
            elif b["type"] == "thinking" and options.thinking:
                m["thoughts"].append(b["thinking"])
            elif b["type"] == "tool_use":
                m["uses"].append([b["id"], b["name"], json.dumps(b["input"], separators=(",", ":")), None, None])
            elif b["type"] == "tool_result":
                m["results"].append((b["tool_use_id"], b["content"], b.get("is_error") is True))
        own = "\n".join(x for x in own if x)
        m["texts"].append(re.sub("(?s)<system-reminder>.*?</system-reminder>", "", own) if r["type"] == "user" else own)
    for m in drafts:
        text, thought = "\n".join(x for x in m["texts"] if x), "\n".join(m["thoughts"])
        text = f"[thinking] {thought}" + (f"\n{text}" if text else "") if thought else text
        for u in m["uses"]:
            pending[u[0]] = u
        for i, t, e in m["results"]:
            if i in pending:
                pending.pop(i)[3:] = [t, e]
        blank = not (text or m["uses"] or m["results"])
        if m["usage"] and m["role"] == "assistant":
            usage.append((session, None if blank else len(messages), m["usage"]["input_tokens"]))
        if blank:
            skip("empty")
            continue
        if m["compact"]:
            compactions.append((session, len(messages)))
        messages.append((session, len(messages), m["role"], text, m["uses"], m["results"]))
    plain = [(*m[:4], [tuple(u) for u in m[4]], m[5]) for m in messages]
    return plain, usage, compactions, {(session, k): v for k, v in skipped.items()}


def random_file(rng, n, broken):
    lines, last = [], None
    ids = [f"t{i}" for i in range(n // 3 + 1)]
    for i in range(n):
        kind = rng.choice(["user", "user", "assistant", "assistant", "assistant", "attachment", "summary"])
        parent = last if rng.random() < 0.93 or i < 3 else f"u{rng.randint(0, i - 1)}"
        if broken == "cycle" and i == 0:
            parent = f"u{n // 2}"
        if broken == "orphan" and i == 0:
            parent = "gone"
        record = {"type": kind, "uuid": f"u{i}", "parentUuid": parent}
        if rng.random() < 0.05:
            record["isSidechain"] = True
        if rng.random() < 0.03:
            record["sessionId"] = f"session {rng.randint(0, 3)} of {broken}{n}"
        if kind == "attachment":
            record["rendered"] = [{"content": f"attached {i}"}]
        elif kind == "user":
            blocks = [{"type": "text", "text": rng.choice([f"said {i} <system-reminder>a\nb</system-reminder>ä😀", ""])}]
            blocks += [{"type": "tool_result", "tool_use_id": rng.choice(ids), "content": f"result {i}", "is_error": rng.random() < 0.3}] if rng.random() < 0.6 else []
            record["message"] = {"content": rng.choice([blocks, f"plain {i}"])}
            record["isCompactSummary"] = rng.random() < 0.1
        elif kind == "assistant":
            blocks = [{"type": "text", "text": rng.choice([f"answer {i}", ""])}] + ([{"type": "thinking", "thinking": f"thought {i}"}] if rng.random() < 0.3 else [])
            blocks += [{"type": "tool_use", "id": rng.choice(ids), "name": "Read", "input": {"b": [1, f"x{i}"], "a": None}}] if rng.random() < 0.6 else []
            record["message"] = {"content": blocks, "usage": {"input_tokens": i}} | ({"id": f"m{i // 3}"} if rng.random() < 0.8 else {})
        lines.append(json.dumps(record))
        last = f"u{i}"
        if rng.random() < 0.05:
            lines.append(rng.choice(["not json", "", '{"type": "mode"}']))
    return lines


@pytest.mark.parametrize("options", [transcripts.LoadOptions(), transcripts.LoadOptions(sidechains=True, attachments=True, thinking=True)])
def test_split_files(spark, tmp_path, options):
    """Files of many splits, with a long chain, a cycle and an orphan, give what a walk over each file's lines gives."""
    rng = random.Random(11)
    files = {f"f{i}": random_file(rng, n, broken) for i, (n, broken) in enumerate([(1200, ""), (300, "cycle"), (300, "orphan"), (1, ""), (80, ""), (0, "")])}
    for name, lines in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = transcripts.read_transcripts(spark, str(tmp_path), options)
        messages = sorted(((r[0], r[1], r[2], r[3], [tuple(u) for u in r[4]], [tuple(x) for x in r[5]]) for r in got.messages.collect()), key=str)
        want = [parsed(lines, name, options) for name, lines in files.items()]
        assert messages == sorted((m for w in want for m in w[0]), key=str)
        assert sorted((tuple(r)[:3] for r in got.usage.collect()), key=str) == sorted((u for w in want for u in w[1]), key=str)
        assert sorted(map(tuple, got.compactions.collect())) == sorted(c for w in want for c in w[2])
        assert {(r[0], r[1]): r[2] for r in got.skipped.collect()} == {k: v for w in want for k, v in w[3].items()}
        assert transcripts.read_records(spark, str(tmp_path), options).filter("file like '%f0%'").select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_redacting_function(spark, tmp_path):
    line = {"type": "assistant", "uuid": "1", "parentUuid": None, "message": {"content": [{"type": "text", "text": "see alice"}, {"type": "tool_use", "id": "t", "name": "Read", "input": {"alice": ["alice", 3]}}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(line))
    row = transcripts.read_transcripts(spark, str(tmp_path), transcripts.LoadOptions(redact=lambda t: t.replace("alice", "<USER>"))).messages.first()
    assert row["text"] == "see <USER>" and json.loads(row["tool_uses"][0]["input"]) == {"alice": ["<USER>", 3]}


def test_captured_sessions(spark, tmp_path):
    key = "sk-ant-" + "k" * 30
    for project, name, n in (("my-app", "a", 3), ("my-app", "b b+", 9), ("other", "c", 6), ("my-app", "small", 1)):
        (tmp_path / "in" / project).mkdir(parents=True, exist_ok=True)
        lines = [{"type": "user" if i % 2 == 0 else "assistant", "uuid": str(i), "parentUuid": str(i - 1) if i else None, "isCompactSummary": i == 2, "message": {"content": [{"type": "text", "text": f"text {i} {key} in /home/alice/x {'word ' * 20}"}], "usage": {"input_tokens": 5}}} for i in range(n)]
        (tmp_path / "in" / project / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    files = capture.session_files(spark, f"{tmp_path}/in", min_bytes=500, project="my").collect()
    assert [(r["project"], r["bytes"] > 500) for r in files] == [("my-app", True)] * 2
    got = {r["session_id"]: r for r in capture.capture_sessions(spark, f"{tmp_path}/in", f"{tmp_path}/out", limit=3, user_paths=True, captured_at="now").collect()}
    assert {k: (r["messages"], r["compactions"], r["secrets"]) for k, r in got.items()} == {"my-app--b b+": (9, 1, 1), "other--c": (6, 1, 1), "my-app--a": (3, 1, 1)}
    cases = datasets.read_cases(spark, f"{tmp_path}/out")
    rows = cases.messages.orderBy("session_id", "message_index").collect()
    assert len(rows) == 18 and all("<SECRET_1> in /home/<USER>/x" in r["text"] and key not in r["text"] for r in rows)
    meta = {r["session_id"]: json.loads(r["meta"]) for r in cases.meta.collect()}
    assert meta["my-app--a"]["input_tokens"] == 5 and meta["my-app--a"]["project"] == "my-app" and meta["my-app--a"]["compactions"] == [2] and meta["my-app--a"]["captured_at"] == "now" and meta["my-app--a"]["source"].endswith("/my-app/a.jsonl")
    assert capture.capture_sessions(spark, f"{tmp_path}/in", f"{tmp_path}/none", limit=3, min_bytes=10**9).count() == 0
