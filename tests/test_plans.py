"""Plans of steps that many queries share: what they shuffle, and how often they look at a text."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell import queries
from tracewell.config import EngineConfig, GraphOptions
from tracewell.functions import text
from tracewell.operators import archive, evals, graph, ledger, rebuild, scoring
from tracewell.plans import compaction

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@tables
@pytest.mark.parametrize("name", ["reason_counts", "calibration_check", "threshold_sweep", "mode_aggregate", "fidelity_scores"])
def test_what_filters_decisions_does_not_score_again(spark, name):
    plan = optimized(queries.QUERIES[name](spark, SF_DIR))
    assert "regexp_extract_all" not in plan and "Window" not in plan


@tables
def test_calls_are_shuffled_once(spark):
    assert exchanges(ledger.tool_calls(queries._session(spark, SF_DIR).localCheckpoint())) == 1


@tables
def test_anchors_of_an_event_are_looked_for_once(spark):
    plan = optimized(graph.references_of_calls(ledger.ledger(queries._session(spark, SF_DIR).localCheckpoint()), GraphOptions()))
    assert plan.count("Generate inline") == 1
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract_all" in line]
    assert "sha2" not in plan


@tables
def test_events_meet_results_without_another_shuffle(spark):
    edges = graph.dependency_edges(ledger.ledger(queries._session(spark, SF_DIR).localCheckpoint()), GraphOptions())
    assert exchanges(graph.reference_strength(edges)) == 1


def test_results_beyond_the_newest_and_symbols_of_many_have_no_edge(spark):
    rows = [("s", f"e{i}", i, "tool_result", f"symbol handleItem{i % 2} lib/m.py", f"t{i}", 2 * i) for i in range(6)] + [("s", "u", 6, "user_text", "handleItem0 handleItem1 lib/m.py", None, 99), ("s", "last", 7, "tool_use", "", "t7", 100)]
    events = spark.createDataFrame(rows, "session_id string, event_id string, seq long, kind string, content string, tool_use_id string, message_index int")
    edges = lambda **o: sorted((r["to_id"], r["via"]) for r in graph.dependency_edges(events, GraphOptions(**o)).collect())
    assert edges() == [(f"e{i}", "path") for i in range(6)]
    assert edges(max_results=2) == [("e4", "path"), ("e5", "path")]
    plain = events.withColumn("content", F.regexp_replace("content", " lib/m.py", ""))
    found = lambda **o: sorted(r["to_id"] for r in graph.dependency_edges(plain, GraphOptions(**o)).collect())
    assert found() == [f"e{i}" for i in range(6)] and found(results_per_symbol=2) == [] and found(max_results=4, results_per_symbol=2) == ["e2", "e3", "e4", "e5"]


def test_mentions_are_those_of_the_paths(spark):
    rows = [("see SRC\\F1.ts", ["src/f1.ts"]), ("./src/f1.ts", ["src/f1.ts"]), ("src/f1.tsx", ["src/f1.ts"]), ("asrc/f1.ts", ["src/f1.ts"]), ("src f1.ts", ["src/f1.ts"]), ("x", []), ("src/f1.ts", None)]
    got = spark.createDataFrame(rows, "text string, paths array<string>").select(scoring._mentions(F.col("text"), F.col("paths"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False]


def test_calls_without_result_or_id_have_no_row(spark):
    none = None
    use = lambda i: (i, "Bash", '{"command":"a"}', none, none)
    kind = "session_id string, message_index int, role string, text string, tool_uses array<struct<tool_use_id: string, tool: string, input: string, text: string, is_error: boolean>>, tool_results array<struct<tool_use_id: string, text: string, is_error: boolean>>"
    messages = spark.createDataFrame([("s", 0, "assistant", "", [use("a"), use("b"), use(none), use("c")], []), ("s", 1, "user", "", [], [("a", "old", True), ("a", none, none), (none, "x", False)]), ("s", 2, "assistant", "", [use("c")], [("c", "r", True)])], kind)
    got = ledger.tool_calls(messages).select("call_seq", "tool_use_id", "result", "is_error", "call_index", "result_index", "ambiguous").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", "", False, 0, 1, False), (2, "c", "r", True, 0, 2, True), (3, "c", "r", True, 2, 2, True)]


@tables
def test_rebuilding_and_its_check_shuffle_once(spark):
    messages = queries._session(spark, SF_DIR).localCheckpoint()
    decisions = compaction.decided(messages, EngineConfig(redact=False), archive_ids=True).localCheckpoint()
    assert exchanges(evals.structure_valid(rebuild.apply_actions(messages, decisions, EngineConfig()))) == 1


_KIND = "session_id string, message_index int, role string, text string, tool_uses array<struct<tool_use_id: string, tool: string, input: string, text: string, is_error: boolean>>, tool_results array<struct<tool_use_id: string, text: string, is_error: boolean>>"


def _odd(spark):
    use = lambda i: (i, "Bash", '{"command":"a"}', None, None)
    told = lambda i, x="x": (i, x, False)
    rows = [(0, "go", [], []), (1, "", [use("a"), use("b"), use(None)], []), (2, "", [], [told("a"), told("b", "y"), told(None)]), (3, None, None, [told("a")]), (4, "", [use("a")], [told("a"), told("c"), told("a")]), (5, "", [use("b")], None), (6, "", [use("c")], [])]
    return spark.createDataFrame([("s", i, "user", *rest) for i, *rest in rows], _KIND)


def test_calls_name_the_records_that_the_ledger_does(spark):
    messages = _odd(spark)
    got = {(r["tool_use_id"], r["archive_id"]) for r in ledger.tool_calls(messages, archive_ids=True).collect()}
    want = {(r["tool_use_id"], r["result_id"]) for r in ledger.interactions(ledger.ledger(messages)).filter("tool_use_id is not null").collect()}
    assert got == want and {i[-2:] for k, i in got if k == "a"} == {"~3"}


def test_odd_messages_are_rebuilt_with_and_without_names_of_records(spark):
    messages = _odd(spark)
    decisions = spark.createDataFrame([("s", i, "Bash", "ARCHIVE_ONLY", False, '{"command":"a"}', f"e_{i}") for i in ("a", None)], "session_id string, tool_use_id string, tool string, action string, is_error boolean, input string, archive_id string")
    rows = rebuild.apply_actions(messages, decisions, EngineConfig()).orderBy("message_index").collect()
    ids = [(r["message_index"], r["text"], *(None if r[c] is None else [x["tool_use_id"] for x in r[c]] for c in ("tool_uses", "tool_results"))) for r in rows]
    note = "[archived 1 tool call made here: Bash command=a -> e_a - out of context]"
    assert ids == [(0, "go", [], []), (1, note, ["b", None], []), (2, "", [], ["b", None]), (3, None, None, ["a"]), (4, note, [], ["c"]), (5, "", ["b"], None), (6, "", ["c"], [])]
    plain = rebuild.apply_actions(messages, decisions.drop("archive_id"), EngineConfig()).orderBy("message_index").collect()
    assert [r[:2] for r in plain] == [r[:2] for r in rows] and "-> e_" in plain[1]["text"]
    checked = evals.structure_valid(messages).first()
    assert checked["faults"] == rebuild.structure_faults(messages).count() == 2 and not checked["valid"]


def test_paths_errors_and_fields_are_as_their_patterns_say(spark):
    from tracewell.functions import text

    rows = ["see a/b.py, C:\\d\\E.txt:3 x", "x=./q/r.c\nq/r.c a//b.c (z/y.tar.gz)", "-a/b.c9 9a/b.c b.c /etc/x.conf", "é/a.b éa/b.c", "a/ b.c", "", "no slash", None, "panic: x\nok\nMyError: y", "pan ic", '{"p\\u0061th": "u", "command": 5}', '{"path": "", "filePath": "f"}', "path"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    t = F.col("t")
    plain = F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(text._PATH), F.lit(0)), text.normal_path)), text.no_strings())
    marked = F.transform(F.filter(text.lines_in(t), lambda x: x.rlike(text.ERROR_LINE)), lambda x: text.truncate(x, 120))
    errors = F.when(t.isNotNull(), F.array_distinct(F.concat(marked, F.regexp_extract_all(t, F.lit(text.ERROR_CLASS), F.lit(0))))).otherwise(text.no_strings())
    got = df.select(text.paths_in(t).alias("a"), plain.alias("b"), text.errors_in(t).alias("c"), errors.alias("d"), text.json_string(t, "path").alias("e"), F.get_json_object("t", "$.path").alias("f"), text.json_string(t, "command").alias("g"), F.get_json_object("t", "$.command").alias("h")).collect()
    for r in got:
        assert (r.a, r.c, r.e, r.g) == (r.b, r.d, r.f, r.h)


@tables
@pytest.mark.parametrize("name", ["search_topk", "rank_records", "session_search", "ancestor_stats", "fit_stage"])
def test_what_is_read_again_is_written(spark, name):
    plan = optimized(queries.QUERIES[name](spark, SF_DIR))
    assert "Generate inline" not in plan and "get_json_object" not in plan


@tables
def test_chains_send_no_table_through_the_driver(spark):
    plan = queries.QUERIES["main_chain"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@tables
def test_decisions_are_made_without_holding_results(spark):
    messages = queries._session(spark, SF_DIR).localCheckpoint()
    decided = compaction.decided(messages, EngineConfig()).drop(*compaction.TEXTS, "input", "path", "command")
    lines = [x for x in decided._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    # A result is read once, before the rules' windows: the only one that holds it pairs uses with results.
    assert lines and not [x for x in lines if "rlike" in x.lower()]
    plan = decided._jdf.queryExecution().optimizedPlan().toString().splitlines()
    read = next(i for i, x in enumerate(plan) if "RLIKE" in x)
    rules = [i for i, x in enumerate(plan) if "Window [" in x and "canonical_input" in x]
    assert rules and all(i < read for i in rules)



def test_first_batch_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    records = spark.createDataFrame([("s", "a", "h"), ("s", "b", "i"), ("t", "a", "j"), ("s", "a", "h")], "session_id string, id string, content_hash string").mapInArrow(counted, "session_id string, id string, content_hash string")
    known = spark.createDataFrame([], "session_id string, id string, content_hash string")
    assert archive.fresh_records(known, records).count() == 3
    assert read.value == 4


def test_tokens_are_those_of_the_patterns(spark):
    rows = [None, "", "   ", "a", "aaaaaa", "aaaaaaa", "abcdefg 12 é日 \U0001f600x9\n\t$$ a1b22c", "\x0b\x0c\r x", "12.5%", "$1 \\ a$a"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    t = F.coalesce(F.col("t"), F.lit(""))
    listed = F.regexp_count(t, F.lit("[A-Za-z]{1,6}")) * 10 + F.regexp_count(t, F.lit("[0-9]")) * 5 + F.regexp_count(t, F.lit(r"[^\t-\r A-Za-z0-9]")) * 9
    got = df.select(text.token_tenths(F.col("t")).alias("a"), listed.alias("b"), text.tokens_in_all(F.array("t", F.lit("ab 1"))).alias("c"), (F.floor((listed + 9) / 10) + 2).alias("d")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.c for r in got] == [r.d for r in got]
    assert "regexp_extract_all" not in optimized(df.select(text.tokens_in_all(F.array("t"))))


def test_only_words_shaped_like_an_id_are_anchors(spark):
    rows = [("s", "r0", 0, "tool_result", "", "t1", 0), ("s", "r1", 1, "tool_result", "", None, 1), ("s", "u", 2, "user_text", "see t1, t2, x1 and t11", None, 9), ("z", "v", 0, "user_text", "t1", None, 0)]
    events = spark.createDataFrame(rows, "session_id string, event_id string, seq long, kind string, content string, tool_use_id string, message_index int")
    assert [(r.session_id, r.from_id, r.to_id, r.via) for r in graph.dependency_edges(events).collect()] == [("s", "u", "r0", "tool_id")]
    plan = optimized(graph.dependency_edges(events))
    assert "collect_set" in plan and plan.count("regexp_extract_all(content") <= 3


def _searched(spark):
    from tracewell.schema import ARCHIVE
    from tests.test_engine import record

    words = ["uploading", "src/upload/io.py", "upload_handler", "preupload", "handlers", "tiny", "up", "deck.", "MAX_SIZE"]
    rows = [record(f"r{i}", " ".join(words[j] for j in range(9) if (i >> j % 5) & 1 or i % 9 == j) + f" build {i // 2}", "st"[i % 2], i) for i in range(40)]
    prompts = [("q1", "where is upload_handler, and who sets MAX_SIZE?"), ("q2", "upload the handlers to src/upload/io.py again"), ("q3", "build 7 of the tiny decks: deck."), ("q4", "nothing at all")]
    return spark.createDataFrame(prompts, "query_id string, text string"), spark.createDataFrame(rows, ARCHIVE)


def test_marks_are_what_trying_all_terms_gives():
    import random
    import re

    from tracewell.functions.terms import TERM
    from tracewell.operators import search

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["ab", "abc", "b", "c", "_", ".", "/", "-", " ", "é"]) for _ in range(n))
    for _ in range(300):
        wanted = sorted({t for t in re.findall(TERM, text(60)) if len(t) >= 3})
        content, about = text(60), text(8)
        want = {}
        parts = lambda x: "/" + re.sub(r"[_.\-/\\]", "/", x) + "/"
        for n, term in enumerate(wanted):
            for token in re.findall(TERM, content):
                tenths = 10 if term == token else 0 if len(term) < 4 or term not in token else 9 if parts(term) in parts(token) else 4 if len(term) >= 5 else 0
                want[n] = max(want.get(n, 0), tenths)
            if term in re.findall(TERM, about):
                want[n] = 12
        assert search._marker([(t, n) for n, t in enumerate(wanted)])(content, about) == [n * 16 + t for n, t in sorted(want.items()) if t]


def test_search_finds_the_same_in_several_scans_and_without_broadcasts(spark, monkeypatch):
    from tracewell.operators import retrieve, search

    prompts, records = _searched(spark)
    want = [sorted(map(tuple, f.collect())) for f in (search.rank_records(prompts, records), retrieve.rehydrate(prompts, records))]
    assert len(want[0]) > 30 and len({r[4] for r in want[0]}) > 5 and want[1]
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 2)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    assert [sorted(map(tuple, f.collect())) for f in (search.rank_records(prompts, records), retrieve.rehydrate(prompts, records))] == want


def test_search_shuffles_marks_once_and_no_texts(spark):
    from tracewell.operators import retrieve, search

    prompts, records = _searched(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ranked = plan(search.rank_records(prompts, records))
    assert ranked.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in ranked
    assert plan(search.search_topk(prompts, records)).count("Exchange hashpartitioning") == 2
    brought = plan(retrieve.rehydrate(prompts, records))
    assert brought.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in brought


def test_texts_are_searched_for_secrets_once(spark, monkeypatch):
    """Each suspicious text goes to the search for secrets once; inputs without secrets stay as they are."""
    from tests.test_engine import transcript, use
    from tracewell.functions import redaction

    searched, plain = spark.sparkContext.accumulator(0), redaction.secrets_of

    def counted(text, detectors):
        searched.add(1)
        return plain(text, detectors)

    monkeypatch.setattr(redaction, "secrets_of", counted)
    secret = "token=" + "ab12" * 10
    parts = [x for i in range(5) for x in (("assistant", "", [use(f"u{i}", "Read", path=f"a{i}")]), ("user", "", [], [(f"u{i}", f"see {secret}{i}", False)]))]
    messages = transcript(spark, ("user", "go"), *parts, ("assistant", "", [use("v", "Bash", command=secret)])).localCheckpoint()
    hidden = redaction.redacted_sessions(messages).orderBy("message_index").collect()
    assert [r["tool_results"][0]["text"] for r in hidden if r["tool_results"]] == [f"see token=<SECRET_{i + 1}>" for i in range(5)]
    assert hidden[-1]["tool_uses"][0]["input"] == '{"command":"token=<SECRET_6>"}' and hidden[1]["tool_uses"][0]["input"] == '{"path":"a0"}'
    assert searched.value == 6
