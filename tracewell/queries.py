"""Queries of the engine's operators over the tables, each with the DuckDB SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import EngineConfig, PolicyOptions
from .functions import sketch, terms, text
from .functions.redaction import redact, redact_messages
from .operators import archive, asking, chains, evals, fit, graph, ledger, retrieve, rules, scoring, search, state
from .plans import compaction
from .schema import TOOL_RESULT, TOOL_USE
from .sources.tables import archive_from_documents, messages_from_conversations, messages_from_events, read
from .storage import fresh_path, table
from .streaming import trigger, usage

CONFIG = EngineConfig()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_conversations(read(spark, sf_dir, "conversations"))


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_events(read(spark, sf_dir, "events"))


def _written_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_session() as a table, as transcripts are: what reads them many times doesn't derive them as often."""
    return table(_session(spark, sf_dir), "session")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.tool_calls(_session(spark, sf_dir), CONFIG.preserve_recent)


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_from_documents(read(spark, sf_dir, "documents"))


def _tokens(column: str) -> str:
    return f"((10 * len(regexp_extract_all({column}, '[A-Za-z]{{1,6}}')) + 5 * len(regexp_extract_all({column}, '[0-9]')) + 9 * len(regexp_extract_all({column}, '[^\\t-\\r A-Za-z0-9]')) + 9) // 10)"


_TURNS = "m as (select cast(conv_id as varchar) as session_id, cast(turn as int) as message_index, role, coalesce(text, '') as text, count(*) over (partition by conv_id) as total from conversations)"

#: Calls as messages_from_events() makes them.
_CALLS = """
e as (
    select cast(user_id as varchar) as session_id, event_id, event_type as kind, cast(json_extract_string(props, '$.k') as int) as k,
           row_number() over (partition by user_id order by ts, event_id) - 1 as n,
           count(*) over (partition by user_id) as cnt
    from events
),
c0 as (
    select *, n + 1 as call_seq, 'u' || event_id as tool_use_id, 2 * n as call_index, 2 * n + 1 as result_index, 2 * cnt as total, kind = 'error' as is_error, 'src/f' || k || '.ts' as p,
           case when kind = 'view' then 'Read' when kind = 'click' then 'Grep' when kind = 'purchase' then 'Edit' when kind = 'signup' and k >= 90 then 'WebFetch' else 'Bash' end as tool
    from e
),
c as (
    select *, case when tool in ('Read', 'Grep', 'Edit') then p end as path, case when tool = 'Bash' then 'run ' || k end as command,
           case when tool = 'Bash' then '{"command":"run ' || k || '"}' when tool = 'WebFetch' then '{"url":"https://example.org/' || k || '"}' else '{"file_path":"' || p || '"}' end as input,
           repeat(kind || ' printed this line, of forty characters or more, about ' || p || chr(10), k % 5 + 1) as result,
           n = 0 or result_index >= total - 6 as pinned
    from c0
)"""

_RULES = (
    _CALLS
    + """,
later as (
    select a.*,
        exists (select 1 from c b where b.session_id = a.session_id and b.tool = a.tool and b.call_index > a.call_index and not b.is_error
                and case when a.command is not null then b.command = a.command when a.path is not null then b.path = a.path else true end) as resolved,
        exists (select 1 from c b where b.session_id = a.session_id and b.tool = 'Edit' and b.path = a.path and b.call_index > a.call_index) as changed,
        exists (select 1 from c b where b.session_id = a.session_id and b.tool = a.tool and b.input = a.input and b.call_index > a.call_index) as superseded,
        a.tool <> 'Edit' and exists (select 1 from c b where b.session_id = a.session_id and b.tool = 'Edit' and b.path = a.path and b.call_index >= b.total - 12) as current_file,
        (select max(b.call_seq) from c b where b.session_id = a.session_id and b.tool = a.tool and b.input = a.input and b.result = a.result) as last_copy
    from c a
),
r as (
    select later.*, case when not pinned and length(result) >= 40 and last_copy > call_seq then last_copy end as copy_seq from later
)"""
)

_GRAPH = """,
l as (
    select session_id, n as m, 'user_text' as from_kind, p from c where k % 25 = 0
    union all select session_id, n, 'assistant_text', p from c where k % 4 = 0
    union all select session_id, n, 'tool_use', path from c where path is not null
),
g as (
    select c.session_id, c.tool_use_id, l.m, l.from_kind, c.p
    from c join l on l.session_id = c.session_id and l.p = c.p and case when l.from_kind = 'user_text' then l.m > c.n else 2 * l.m - c.result_index > 2 end
),
s as (
    select session_id, tool_use_id, count(*) filter (from_kind = 'user_text') as strong,
           case when count(*) filter (from_kind = 'user_text') > 0 then 0 else count(*) end as weak
    from g group by all
)"""

_SCORES = (
    _RULES
    + _GRAPH
    + """,
recent as (
    select distinct session_id, p from c where (k % 4 = 0 and call_index >= total - 6) or (k % 25 = 0 and result_index >= total - 6)
),
k0 as (
    select r.*, coalesce(s.strong, 0) as strong, coalesce(s.weak, 0) as weak, rp.p is not null as mentioned,
           case when tool in ('Read', 'Grep') then 0.4e0 when tool = 'Edit' then 0.7e0 else 0.5e0 end as kc0,
           case when is_error then case when resolved then 0.2e0 else 0.75e0 end
                when tool in ('Read', 'Grep') then 0.25e0 when tool = 'Edit' then 0.3e0
                when tool = 'WebFetch' then 0.7e0
                when length(result) < 200 then 0.2e0 else 0.45e0 end as kr0,
           0.5e0 + 0.5e0 * greatest(0e0, least(1e0, 1 - greatest(0, total - 1 - result_index) / 20e0)) as scale
    from r left join s using (session_id, tool_use_id)
    left join recent rp on rp.session_id = r.session_id and rp.p = r.p
),
k1 as (
    select *, kc0 * scale * case when superseded then 0.5e0 else 1e0 end as kc,
           kr0 * scale * case when superseded then 0.3e0 else 1e0 end + case when mentioned then 0.2e0 else 0e0 end as kr
    from k0
),
k2 as (
    select *, least(1e0, kc) as keep_call, least(1e0, kr) as keep_result,
           list_filter([case when is_error and not resolved then 'unresolved_error' end, case when tool = 'WebFetch' then 'non_reproducible' end,
                        case when strong > 0 then 'referenced_later' end, case when current_file then 'current_file' end], lambda x: x is not null) as protections
    from k1
)"""
)


def _decided(threshold: str) -> str:
    return f""",
k3 as (select *, least(1e0, keep_result + case when weak > 0 then 0.2e0 else 0e0 end) as br, {threshold} as t from k2),
v as (
    select *, case when pinned then 'PIN_VERBATIM' when len(protections) > 0 then 'KEEP_VERBATIM' when copy_seq is not null then 'DROP_REDUNDANT'
                   when br >= t then 'KEEP_VERBATIM' when keep_call >= t then case when tool in ('Read', 'Grep') and not changed then 'RERUN_ON_DEMAND' else 'KEEP_HEAD_TAIL' end
                   else 'ARCHIVE_ONLY' end as action,
           case when pinned or len(protections) > 0 or copy_seq is not null then 1e0 when br >= t then br when keep_call >= t then 1 - br else least(1 - br, 1 - keep_call) end as confidence
    from k3
)"""


# ---- messages, tokens, ledger


@query(f"with {_TURNS} select session_id, count(*) as messages, cast(sum({_tokens('text')}) as bigint) as tokens, cast(sum(length(text)) as bigint) as chars, count(*) filter (message_index = 0 or message_index >= total - 6) as pinned_messages from m group by 1")
def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.session_totals(_turns(spark, sf_dir), CONFIG.preserve_recent)


@query(f"with {_TURNS} select session_id, message_index, role, message_index = 0 or message_index >= total - 6 as pinned from m")
def pinned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_pins(_turns(spark, sf_dir), CONFIG.preserve_recent).select("session_id", "message_index", "role", "pinned")


_EVENTS = (
    f"with {_TURNS}, t as (select *, case when role = 'assistant' then 'assistant_text' else 'user_text' end as kind, row_number() over (partition by session_id order by message_index) - 1 as seq from m where regexp_replace(text, '[\\t-\\r ]', '', 'g') <> ''), "
    "b as (select *, 'e_' || substr(sha256(kind || chr(31) || chr(31) || text), 1, 16) as base from t), "
    "i as (select *, row_number() over (partition by session_id, base order by seq) as nth from b) "
)


@query(_EVENTS + f"select session_id, seq, base || case when nth > 1 then '~' || nth else '' end as event_id, role, kind, message_index, substr(sha256(text), 1, 16) as content_hash, {_tokens('text')} as token_estimate from i")
def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger(_turns(spark, sf_dir)).select("session_id", "seq", "event_id", "role", "kind", "message_index", "content_hash", "token_estimate")


@query(_EVENTS + "select substr(sha256(text), 1, 16) as content_hash, count(*) as events, count(distinct session_id) as sessions from i group by 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger(_turns(spark, sf_dir)).groupBy("content_hash").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


@query(
    "with t as (select cast(source as varchar) as session_id, doc_id, coalesce(text, '') as x, 'e_' || substr(sha256('user_text' || chr(31) || chr(31) || coalesce(text, '')), 1, 16) as base from documents where regexp_replace(coalesce(text, ''), '[\\t-\\r ]', '', 'g') <> ''), "
    "i as (select *, row_number() over (partition by session_id, base order by doc_id) as nth from t) select session_id, doc_id, base || case when nth > 1 then '~' || nth else '' end as event_id from i"
)
def event_id_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    messages = docs.select(F.col("source").alias("session_id"), F.col("doc_id").cast("int").alias("message_index"), F.lit("user").alias("role"), text.nonnull(F.col("text")).alias("text"), F.array().cast("array<struct<tool_use_id: string, tool: string, input: string, text: string, is_error: boolean>>").alias("tool_uses"), F.array().cast("array<struct<tool_use_id: string, text: string, is_error: boolean>>").alias("tool_results"))
    return ledger.ledger(messages).select("session_id", F.col("message_index").cast("long").alias("doc_id"), "event_id")


@query(f"with {_CALLS} select session_id, call_index as message_index, length(input) + case when k % 4 = 0 then length('Looking at ' || p || ' again.') else 0 end as chars from c union all select session_id, result_index, length(result) + case when k % 25 = 0 then length('You saw this:' || chr(10) || kind || ' printed this line, of forty characters or more, about ' || p) else 0 end from c")
def message_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.message_chars(_session(spark, sf_dir))


# ---- calls and rules


@query(f"with {_CALLS} select session_id, call_seq, tool_use_id, tool, path, command, is_error, length(result) as result_chars, call_index, result_index, total, pinned from c")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("session_id", "call_seq", "tool_use_id", "tool", "path", "command", "is_error", "result_chars", "call_index", "result_index", "total", "pinned")


@query(f"with {_RULES} select session_id, call_seq, tool from r where is_error and not resolved")
def unresolved_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).withColumn("x", rules.unresolved_error()).filter("x").select("session_id", "call_seq", "tool")


@query(f"with {_RULES} select session_id, call_seq, path from r where changed")
def target_changed_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).withColumn("x", rules.target_changed_later()).filter("x").select("session_id", "call_seq", "path")


@query(f"with {_RULES} select session_id, call_seq, path from r where current_file")
def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).withColumn("x", rules.current_file(CONFIG.rules.current_window)).filter("x").select("session_id", "call_seq", "path")


@query(f"with {_RULES} select session_id, call_seq, tool from r where superseded")
def superseded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).withColumn("x", rules.superseded()).filter("x").select("session_id", "call_seq", "tool")


@query(f"with {_RULES} select r.session_id, r.call_seq, l.tool_use_id as duplicate_of from r join c l on l.session_id = r.session_id and l.call_seq = r.copy_seq")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exact_duplicates(_calls(spark, sf_dir)).filter("duplicate_of is not null").select("session_id", "call_seq", "duplicate_of")


@query(f"with {_CALLS} select session_id, call_seq, tool from c where tool = 'WebFetch'")
def non_reproducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).filter(rules.non_reproducible(CONFIG.rules.non_reproducible)).select("session_id", "call_seq", "tool")


@query(f"with {_CALLS}{_GRAPH} select session_id, from_kind, count(*) as edges, count(distinct tool_use_id) as results from g group by all")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.dependency_edges(ledger.ledger(_session(spark, sf_dir)), CONFIG.graph)
    return edges.groupBy("session_id", "from_kind").agg(F.count("*").alias("edges"), F.count_distinct("to_id").alias("results"))


@query(f"with {_CALLS}{_GRAPH} select session_id, tool_use_id, strong, weak from s")
def reference_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.references_of_calls(ledger.ledger(_session(spark, sf_dir)), CONFIG.graph)


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the events in which errors, quotes, symbols, paths and calls are spoken of again."""
    k = F.get_json_object("props", "$.k").cast("int")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("id"), k.alias("k"), (F.row_number().over(order) - 1).alias("n"), F.lag("event_id").over(order).alias("before"))
    text, none = F.col("k").cast("string"), F.lit("")
    kinds = [F.concat(F.lit("TypeError: value "), text, F.lit(" is not known here")), F.concat(F.lit("the long line number "), text, F.lit(" that somebody may want to quote later on"))]
    pick = lambda *c: F.element_at(F.array(*c), F.col("k") % 5 + 1)
    result = pick(*kinds, F.concat(F.lit("symbol handleItem"), text, F.lit(" found")), F.concat(F.lit("see lib/m"), text, F.lit(".py")), F.concat(F.lit("plain "), text))
    said = pick(*kinds, F.concat(F.lit("now handleItem"), text, F.lit(" again")), F.concat(F.lit("open lib/m"), text, F.lit(".py")), F.concat(F.lit("see call u"), F.coalesce(F.col("before").cast("string"), none)))
    uses, results = (f"array<{t}>" for t in (TOOL_USE, TOOL_RESULT))
    use = F.array(F.struct(F.col("id").alias("tool_use_id"), F.lit("Task").alias("tool"), F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}")).alias("input"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("is_error")))
    answer = F.array(F.struct(F.col("id").alias("tool_use_id"), result.alias("text"), F.lit(False).alias("is_error")))
    message = lambda i, role, words, u, r: F.struct((F.col("n") * 2 + i).cast("int").alias("message_index"), F.lit(role).alias("role"), words.alias("text"), u.cast(uses).alias("tool_uses"), r.cast(results).alias("tool_results"))
    return rows.select("session_id", F.inline(F.array(message(0, "assistant", said, use, F.array()), message(1, "user", F.when(F.col("k") % 7 == 0, said).otherwise(none), F.array(), answer))))


_EDGES = (
    """with e as (
    select cast(user_id as varchar) as session_id, 'u' || event_id as id, cast(json_extract_string(props, '$.k') as int) as k, row_number() over w - 1 as n, lag(event_id) over w as before
    from events window w as (partition by user_id order by ts, event_id)
),
t as (
    select *, case k % 5 when 0 then 'TypeError: value ' || k || ' is not known here' when 1 then 'the long line number ' || k || ' that somebody may want to quote later on' end as line,
           case k % 5 when 2 then 'symbol handleItem' || k || ' found' when 3 then 'see lib/m' || k || '.py' when 4 then 'plain ' || k end as r,
           case k % 5 when 2 then 'now handleItem' || k || ' again' when 3 then 'open lib/m' || k || '.py' when 4 then 'see call u' || coalesce(cast(before as varchar), '') end as s
    from e
),
ev0 as (
    select session_id, 2 * n as m, 0 as pos, 'assistant_text' as kind, coalesce(line, s) as content, null as id from t
    union all select session_id, 2 * n, 1, 'tool_use', '{"n":' || n || '}', id from t
    union all select session_id, 2 * n + 1, 0, 'user_text', coalesce(line, s), null from t where k % 7 = 0
    union all select session_id, 2 * n + 1, 1, 'tool_result', coalesce(line, r), id from t
),
ev as (select *, row_number() over (partition by session_id order by m, pos) - 1 as seq from ev0),
w as (select session_id, seq, kind, id, unnest(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*')) as x, generate_subscripts(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*'), 1) as i from ev),
"""
    + f"""
an as (
    select session_id, seq, kind, 0 as rank, 'path' as via, lower(regexp_extract(content, '{text.PATH}')) as fragment, 1 as i from ev where regexp_matches(content, '{text.PATH}')
    union all select session_id, seq, kind, 1, 'error', content, 1 from ev where regexp_matches(content, '{text.ERROR_LINE}')
    union all select session_id, seq, kind, 1, 'error', regexp_extract(content, '{text.ERROR_CLASS}'), 2 from ev where regexp_matches(content, '{text.ERROR_CLASS}')
    union all select session_id, seq, kind, 2, 'quote', content, 1 from ev where length(content) >= 40
    union all select session_id, seq, kind, 3, 'symbol', x, min(i) from w where length(x) >= 6 and regexp_matches(x, '[A-Z_$0-9]') and lower(x) not in ({", ".join(f"'{x}'" for x in text.COMMON_IDENTIFIERS)}) group by all
    union all select session_id, seq, kind, 4, 'tool_id', id, 1 from ev where kind = 'tool_result'
    union all select session_id, seq, kind, 4, 'tool_id', x, min(i) from w where kind <> 'tool_result' group by all
),
res as (select *, count(*) over (partition by session_id, via, fragment) as n from an where kind = 'tool_result'),
met as (
    select l.session_id, l.seq as from_seq, l.kind as from_kind, r.seq as to_seq, r.via, row_number() over (partition by l.session_id, l.seq, r.seq order by r.rank, l.i, r.fragment) as nth
    from res r join an l on l.session_id = r.session_id and l.via = r.via and l.fragment = r.fragment and l.kind <> 'tool_result' and l.seq > r.seq
    join ev le on le.session_id = l.session_id and le.seq = l.seq join ev re on re.session_id = r.session_id and re.seq = r.seq
    where (r.via <> 'symbol' or r.n <= 3) and (l.kind = 'user_text' or le.m - re.m > 2)
)
select session_id, from_kind, via, count(*) as edges, count(distinct to_seq) as results from met where nth = 1 group by all"""
)


@query(_EDGES)
def edges_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.dependency_edges(ledger.ledger(_varied(spark, sf_dir)), CONFIG.graph)
    return edges.groupBy("session_id", "from_kind", "via").agg(F.count("*").alias("edges"), F.count_distinct("to_id").alias("results"))


# ---- scores, actions


def _decisions(spark: SparkSession, sf_dir: str, config: EngineConfig = CONFIG) -> DataFrame:
    """Decisions as a table, as compact() has them: filters on them would else run the scorer's expressions many times over. Without texts, so no step after the results were read holds them."""
    return table(compaction.decided(_written_session(spark, sf_dir), config).drop(*compaction.TEXTS, "input", "path", "command"), "decisions")


@query(f"with {_SCORES} select session_id, call_seq, array_to_string(protections, ',') as protections, round(keep_call, 6) as keep_call, round(keep_result, 6) as keep_result from k2")
def ruleset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("session_id", "call_seq", F.array_join("protections", ",").alias("protections"), F.round("keep_call", 6).alias("keep_call"), F.round("keep_result", 6).alias("keep_result"))


@query(f"with {_SCORES}{_decided('0.4e0')} select session_id, call_seq, tool, action, round(confidence, 6) as confidence from v")
def decide_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("session_id", "call_seq", "tool", "action", F.round("confidence", 6).alias("confidence"))


@query(f"with {_SCORES}{_decided('0.4e0')} select session_id, count(*) as calls, " + ", ".join(f"count(*) filter (action = '{a}') as {a.lower()}" for a in scoring.ACTIONS) + " from v group by 1")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.action_counts(_decisions(spark, sf_dir))


@query(
    f"with {_SCORES}{_decided('0.4e0')}, q as (select session_id, count(*) as scored, count(*) filter (action = 'KEEP_VERBATIM') as kept, max(keep_result) as best from v where not pinned and len(protections) = 0 and copy_seq is null group by 1) select session_id, scored, round(best, 6) as best from q where scored >= 5 and kept = 0"
)
def calibration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.suspect_calibration(_decisions(spark, sf_dir)).withColumn("best", F.round("best", 6))


_SWEEP = (0.1, 0.2, 0.3, 0.4, 0.5)


@query(" union all ".join(f"select * from (with {_SCORES}{_decided(f'{t}e0')} select cast({t} as double) as threshold, action, count(*) as calls, cast(sum(length(result)) as bigint) as chars from v group by action)" for t in _SWEEP))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by threshold: one scoring, decided once per threshold."""
    scored = _decisions(spark, sf_dir).drop("action", "codes", "confidence")
    out = None
    for t in _SWEEP:
        part = scoring.decide(scored, PolicyOptions(threshold=t)).groupBy("action").agg(F.count("*").alias("calls"), F.sum("result_chars").cast("long").alias("chars")).withColumn("threshold", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select("threshold", "action", "calls", "chars")


@query(f"with {_SCORES} select session_id, call_seq, case when pinned or keep_result >= 0.5e0 then 'keep' when keep_call >= 0.5e0 then 'drop_result' else 'drop_call' end as action from k2")
def ancestor_pruner(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = rules.with_facts(_calls(spark, sf_dir), CONFIG.rules.current_window)
    scored = scoring.RulesetScorer(CONFIG.ruleset).score(calls, _session(spark, sf_dir))
    return scoring.decide_ancestor(scored).select("session_id", "call_seq", "action")


@query(f"with {_SCORES} select session_id, call_seq, round(keep_call, 6) as keep_call, round(keep_result, 6) as keep_result from k2")
def redacted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ruleset_scores with a long key in every result: scores are as without it, so the scorer saw none of them.

    A key of 129 characters would lift short results over the ruleset's 200; its placeholder doesn't.
    """
    key = lambda r: F.concat(F.lit("token=s"), F.sha2(r["tool_use_id"], 256), F.sha2(F.concat(r["tool_use_id"], F.lit("x")), 256), F.lit("\n"))
    planted = _session(spark, sf_dir).withColumn("tool_results", F.transform("tool_results", lambda r: r.withField("text", F.concat(r["text"], key(r)))))
    return compaction.decided(table(planted, "session"), CONFIG).select("session_id", "call_seq", F.round("keep_call", 6).alias("keep_call"), F.round("keep_result", 6).alias("keep_result"))


@query(
    f"with {_CALLS}, f as (select session_id, k, min(n) as first from e group by 1, 2), g as (select *, row_number() over (partition by session_id order by first) as id from f) "
    "select e.session_id, 2 * e.n + 1 as message_index, 'at /home/<USER>/f' || e.k || ' by <SECRET_' || g.id || '>' as line from e join g using (session_id, k)"
)
def redacted_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User paths and secrets of an own kind, planted in every result, as redact_messages() leaves them; numbered by first sight in a session."""
    k = lambda r: F.regexp_extract(r["text"], "src/f([0-9]+)", 1)
    planted = lambda r: F.concat(F.lit("at /home/user"), F.col("session_id"), F.lit("/f"), k(r), F.lit(" by OWN-"), k(r), F.lit("-KIND\n"), r["text"])
    messages = _session(spark, sf_dir).withColumn("tool_results", F.transform("tool_results", lambda r: r.withField("text", planted(r))))
    hidden = redact_messages(messages, user_paths=True, extra=("OWN-[0-9]+-KIND",))
    return hidden.filter(F.size("tool_results") > 0).select("session_id", "message_index", F.substring_index(F.col("tool_results")[0]["text"], "\n", 1).alias("line"))


_TEXTS = """
x as (
    select *, 'e_' || substr(sha256('tool_result' || chr(31) || tool_use_id || chr(31) || result), 1, 16) as aid,
           case when tool = 'Bash' then 'command=run ' || k when tool = 'WebFetch' then 'url=https://example.org/' || k else 'file_path=' || p end as about,
           case when k % 4 = 0 then 'Looking at ' || p || ' again.' else '' end as said,
           case when k % 25 = 0 then 'You saw this:' || chr(10) || kind || ' printed this line, of forty characters or more, about ' || p else '' end as quoted
    from {of}
)"""


@query(
    f"with {_SCORES},{_TEXTS.format(of='k2')}, a as (select *, case when pinned or keep_result >= 0.5e0 then 'keep' when keep_call >= 0.5e0 then 'drop_result' else 'drop_call' end as action from x), "
    "m as (select session_id, length(said) + length(input) as was, action <> 'drop_call' or said <> '' as stays, length(said) + case when action = 'drop_call' then 0 else length(input) end as is_now from a "
    "union all select session_id, length(quoted) + length(result), action <> 'drop_call' or quoted <> '', length(quoted) + case when action = 'drop_call' then 0 when action = 'keep' or length(result) <= 420 then length(result) "
    "else 301 + length('[truncated ' || (length(result) - 300) || ' chars of this tool result' || case when is_error then ' (error)' else '' end || '; re-run the tool if needed]') end from a), "
    "n as (select session_id, count(*) as messages_before, cast(sum(was) as bigint) as chars_before, count(*) filter (stays) as messages_after, cast(sum(is_now) as bigint) as chars_after from m group by 1), "
    "c1 as (select session_id, count(*) as calls, count(*) filter (action = 'keep') as keep, count(*) filter (action = 'drop_result') as drop_result, count(*) filter (action = 'drop_call') as drop_call from a group by 1) "
    "select * from n join c1 using (session_id)"
)
def ancestor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _written_session(spark, sf_dir)
    scored = scoring.RulesetScorer(CONFIG.ruleset).score(rules.with_facts(ledger.tool_calls(messages, CONFIG.preserve_recent), CONFIG.rules.current_window), messages)
    decisions = table(scoring.decide_ancestor(scored).select("session_id", "tool_use_id", "action"), "decisions")
    return scoring.ancestor_stats(messages, scoring.apply_ancestor(messages, decisions), decisions)


# ---- chains of records

#: Records from events: each follows the one before, but for branches; some users' first record has a parent that isn't there, or a later record.
_RECORDS = """
r as (
    select cast(user_id as varchar) as session_id, n, n // 8 as block, n as at, 'r' || n as uuid,
           case when n = 0 and user_id % 9 = 1 then 'gone' when n = 0 and user_id % 9 = 2 then 'r' || (cnt // 2)
                when n > 4 and k % 11 = 0 then 'r' || (n - 2 - k % 3) when n > 0 then 'r' || (n - 1) end as parent, k % 7 <> 3 as leaf
    from (select *, cast(session_id as bigint) as user_id from e)
)"""


@query(
    f"with recursive {_CALLS}, {_RECORDS}, leaves as (select session_id, max(n) as n from r where leaf group by 1), "
    "w as (select r.*, 0 as steps from r join leaves using (session_id, n) "
    "union all select r.*, w.steps + 1 from w join r on r.session_id = w.session_id and r.uuid = w.parent where w.steps <= (select max(n) + 1 from r)), "
    "good as (select session_id, max(steps) as long from w group by 1 having bool_or(parent is null)) "
    "select w.session_id, w.n, good.long - w.steps as place, false as broken from w join good using (session_id) "
    "union all select session_id, n, n as place, true as broken from r where session_id not in (select session_id from good)"
)
def main_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main chain of each user's events, read as records in blocks of eight that name their parents."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.row_number().over(order) - 1).alias("n"), F.count("*").over(Window.partitionBy("user_id")).alias("cnt"))
    named = lambda n: F.concat(F.lit("r"), n.cast("string"))
    n, k, user = F.col("n"), F.col("k"), F.col("user_id")
    parent = F.when((n == 0) & (user % 9 == 1), F.lit("gone")).when((n == 0) & (user % 9 == 2), named(F.floor(F.col("cnt") / 2))).when((n > 4) & (k % 11 == 0), named(n - 2 - k % 3)).when(n > 0, named(n - 1))
    records = e.select(user.cast("string").alias("session_id"), "n", F.floor(n / 8).alias("block"), n.alias("at"), named(n).alias("uuid"), parent.alias("parent"), (k % 7 != 3).alias("leaf"))
    return chains.in_order(records, "session_id").select("session_id", "n", "place", "broken")


# ---- the whole compaction


def _compaction(spark: SparkSession, sf_dir: str) -> compaction.Compaction:
    return compaction.compact(_written_session(spark, sf_dir), CONFIG)


#: The transcripts after compaction: stubs in place of results, markers in place of calls, runs of markers as one.
_AFTER = (
    f"{_SCORES}{_decided('0.4e0')},{_TEXTS.format(of='v')}"
    + """,
y as (
    select *, action in ('ARCHIVE_ONLY', 'DROP_REDUNDANT') as dropped,
           case when action in ('PIN_VERBATIM', 'KEEP_VERBATIM') or length(result) <= 420 then result
                else substr(result, 1, 300) || chr(10) || '[archived ' || aid || ': ' || (length(result) - 300) || ' more chars of this ' || tool || ' result' || case when is_error then ' (error)' else '' end || ' (' || about || '); '
                     || case when action = 'RERUN_ON_DEMAND' then 're-run ' || tool || ' with the same input, or restore ' || aid else 'restore ' || aid || ' brings it back, or re-run the tool' end || ']' end as stub
    from x
),
m as (
    select session_id, call_index as message_index, 'assistant' as role, said as text, case when not dropped then input end as given, null as told, case when dropped then tool || ' ' || about || ' -> ' || aid end as item from y
    union all select session_id, result_index, 'user', quoted, null, case when not dropped then stub end, null from y
),
m1 as (select *, text = '' and given is null and told is null as nothing from m),
m2 as (select *, nothing as only_marker from m1 where not nothing or item is not null),
m3 as (select *, lag(only_marker) over (partition by session_id order by message_index) as before_too from m2),
m4 as (select *, sum(case when only_marker and coalesce(before_too, false) then 0 else 1 end) over (partition by session_id order by message_index) as island from m3),
m5 as (select session_id, min(message_index) as message_index, min(role) as role, max(text) as text, max(given) as given, max(told) as told, string_agg(item, '; ' order by message_index) as items, count(item) as n from m4 group by session_id, island),
rebuilt as (
    select *, case when n = 0 then text else case when text = '' then '' else text || chr(10) || chr(10) end
           || '[archived ' || n || case when n = 1 then ' tool call' else ' tool calls' end || ' made here: ' || items || ' - out of context]' end as full_text
    from m5
)"""
)


@query(
    f"with {_AFTER}, was as (select session_id, 2 * count(*) as messages_before, cast(sum({_tokens('said')} + {_tokens('input')} + {_tokens('quoted')} + {_tokens('result')}) as bigint) as tokens_before, count(*) filter (len(protections) > 0) as protected from x group by 1), "
    f"now as (select session_id, count(*) as messages_after, cast(sum({_tokens('full_text')} + coalesce({_tokens('given')}, 0) + coalesce({_tokens('told')}, 0)) as bigint) as tokens_after from rebuilt group by 1), "
    "acts as (select session_id, count(*) as calls, " + ", ".join(f"count(*) filter (action = '{a}') as {a.lower()}" for a in scoring.ACTIONS) + " from v group by 1) "
    "select *, round(1 - tokens_after / cast(tokens_before as double), 6) as reduction, 1 - tokens_after / cast(tokens_before as double) >= 0.25e0 as accepted from was join now using (session_id) join acts using (session_id)"
)
def compaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compaction(spark, sf_dir).report


@query(f"with {_AFTER} select session_id, message_index, role, sha256(full_text) as text_sha256, case when given is null then 0 else 1 end as uses, case when told is null then 0 else 1 end as results, sha256(coalesce(given, '') || chr(31) || coalesce(told, '')) as content_sha256 from rebuilt")
def apply_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compaction(spark, sf_dir).messages
    content = F.concat(F.array_join(F.transform("tool_uses", lambda u: u["input"]), "\n"), F.lit("\x1f"), F.array_join(F.transform("tool_results", lambda r: r["text"]), "\n"))
    return rows.select("session_id", "message_index", "role", F.sha2("text", 256).alias("text_sha256"), F.size("tool_uses").alias("uses"), F.size("tool_results").alias("results"), F.sha2(content, 256).alias("content_sha256"))


@query(
    f"with {_SCORES}{_decided('0.4e0')} select session_id, action, 'tool_result' as kind, count(*) as records, cast(sum(length(result)) as bigint) as chars from v where action not in ('PIN_VERBATIM', 'KEEP_VERBATIM') group by all union all select session_id, action, 'tool_use', count(*), cast(sum(length(input)) as bigint) from v where action in ('ARCHIVE_ONLY', 'DROP_REDUNDANT') group by all"
)
def archive_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = archive.fresh_records(spark.createDataFrame([], "session_id string, id string, content_hash string"), _compaction(spark, sf_dir).archive)
    return fresh.groupBy("session_id", "action", "kind").agg(F.count("*").alias("records"), F.sum(F.length("content")).cast("long").alias("chars"))


@query(
    f"with {_SCORES}{_decided('0.4e0')}, a as (select session_id, 'e_' || substr(sha256('tool_result' || chr(31) || tool_use_id || chr(31) || result), 1, 16) as id, action, length(result) as chars, call_seq from v where action not in ('PIN_VERBATIM', 'KEEP_VERBATIM')) select session_id, id, action, chars from a where call_seq % 10 = 0"
)
def archive_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every tenth call, put into an archive in two batches (the first of them twice) and read back."""
    made = _compaction(spark, sf_dir)
    store = archive.Archive(spark, fresh_path(spark, "archive"), buckets=16)
    results = table(made.archive.filter("kind = 'tool_result'"), "archive-results")  # three batches read them
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for part, name in ((results.filter(even), "one"), (results.filter(even), "again"), (results, "all")):
        store.put(part, name)
    tenth = made.decisions.filter("call_seq % 10 = 0").select("session_id", "tool_use_id")
    return store.read().join(tenth, ["session_id", "tool_use_id"]).select("session_id", "id", "action", F.length("content").cast("long").alias("chars"))


@query(f"with {_CALLS} select session_id, count(*) filter (k % 13 in (1, 2)) as faults, count(*) filter (k % 13 in (1, 2)) = 0 as valid from c group by 1")
def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of which some uses are lost and some come a message after their results."""
    uses = F.col("tool_uses")
    k = F.regexp_extract(uses[0]["input"], "([0-9]+)", 1).cast("int")
    messages = _session(spark, sf_dir)
    marked = messages.withColumn("kind", F.when(F.size(uses) > 0, F.when(k % 13 == 1, "lost").when(k % 13 == 2, "late")))
    late = marked.filter("kind = 'late'").withColumn("message_index", F.col("message_index") + 1_000_000).drop("kind")
    kept = marked.withColumn("tool_uses", F.when(F.col("kind").isNull(), uses).otherwise(F.slice(uses, 1, 0))).drop("kind")
    return evals.structure_valid(kept.unionByName(late))


@query(f"with {_CALLS} select distinct session_id, cast(0 as bigint) as faults, true as valid from c")
def structure_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.structure_valid(_compaction(spark, sf_dir).messages).withColumn("faults", F.col("faults").cast("long"))


# ---- archive


@query(f"select source as session_id, count(*) as records, cast(sum({_tokens('text')}) as bigint) as tokens, grouping(source) as overall from documents group by rollup (source)")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.totals(_archive(spark, sf_dir))


@query("with d as (select cast(doc_id as varchar) as id, source as session_id, doc_id as seq, trim(regexp_replace(text, '[\\t-\\r ]+', ' ', 'g')) as p from documents) select id, session_id, seq, case when length(p) <= 120 then p else substr(p, 1, 119) || '…' end as preview from d")
def archive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.summaries(_archive(spark, sf_dir)).select("id", "session_id", "seq", "preview")


@query("select cast(doc_id as varchar) as id, source as session_id, doc_id as seq from documents qualify row_number() over (order by doc_id desc) <= 20")
def archive_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.newest(_archive(spark, sf_dir), 20).select("id", "session_id", "seq")


# ---- text


@query(f"select page_id, array_to_string(list_distinct_in_order, ',') as paths from (select page_id, (select list(x order by i) from (select x, min(i) as i from (select lower(regexp_replace(u, '\\\\', '/', 'g')) as x, i from unnest(regexp_extract_all(url, '{text.PATH}')) with ordinality as t(u, i)) group by x)) as list_distinct_in_order from pages) where len(list_distinct_in_order) > 0")
def extract_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(text.paths_in(F.col("url")), ",").alias("paths")).filter("paths <> ''")


_STOP_SQL = ", ".join(f"'{w}'" for w in text.COMMON_IDENTIFIERS)


@query(f"with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) as x, generate_subscripts(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'), 1) as i from documents), s as (select doc_id, x, min(i) as i from w where length(x) >= 6 and regexp_matches(x, '[A-Z_$0-9]') and lower(x) not in ({_STOP_SQL}) group by all), t as (select *, row_number() over (partition by doc_id order by i) as nth from s) select doc_id, count(*) as symbols, sha256(string_agg(x, ',' order by i)) as symbols_sha256 from t where nth <= 200 group by 1")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", text.symbols_in(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("symbols"), F.sha2(F.array_join("s", ","), 256).alias("symbols_sha256"))


_CUES_SQL = "case " + " ".join(f"when contains(lower(raw), '{c.replace(chr(39), chr(39) * 2)}') then '{c.strip().replace(chr(39), chr(39) * 2)}'" for c in rules.CUES) + " end"


@query(f"with {_TURNS}, x as (select session_id, message_index, string_split(regexp_replace(text, '([.!?\\n])[\\t-\\r ]+', '\\1' || chr(1), 'g'), chr(1)) as l from m where role = 'user'), y as (select session_id, message_index, unnest(l) as raw, generate_subscripts(l, 1) - 1 as sentence from x), z as (select session_id, message_index, sentence, regexp_replace(raw, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') as text, {_CUES_SQL} as cue from y) select session_id, message_index, sentence, substr(text, 1, 500) as text, cue from z where cue is not null and not starts_with(text, '```') and not starts_with(text, '>')")
def constraint_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.constraints(_turns(spark, sf_dir))


@query(f"with {_CALLS}, h as (select *, trim(regexp_replace(substr(result, 1, 100), '[\\t-\\r ]+', ' ', 'g')) as hd, trim(regexp_replace(right(result, 60), '[\\t-\\r ]+', ' ', 'g')) as tl from c), s as (select session_id, call_seq, 'head=' || hd || '; tail=' || tl as line from h) select session_id, call_seq, case when length(line) <= 240 then line else substr(line, 1, 239) || '…' end as sketch from s")
def sketch_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = sketch.sketch(F.lit("other"), F.col("input"), F.col("result"), F.lit(False))
    return _calls(spark, sf_dir).select("session_id", "call_seq", line.alias("sketch"))


_SKETCHES = (
    f"with {_CALLS}, "
    + """l as (
    select *, trim(regexp_replace(result, '[\\t-\\r ]+', ' ', 'g')) as flat, cast(k % 5 + 1 as varchar) as n_lines, split_part(result, chr(10), 1) as first_line,
           trim(regexp_replace(substr(result, 1, 100), '[\\t-\\r ]+', ' ', 'g')) as h100, trim(regexp_replace(substr(result, 1, 120), '[\\t-\\r ]+', ' ', 'g')) as h120,
           trim(regexp_replace(right(result, 60), '[\\t-\\r ]+', ' ', 'g')) as t60
    from c
),
s as (
    select session_id, call_seq, tool, case
        when is_error then 'ERR: ' || case when length(first_line) <= 120 then first_line else substr(first_line, 1, 119) || '…' end || '; tail=' || t60
        when tool = 'Read' then 'path=' || p || '; lines=' || n_lines || '; imports=0; head=' || case when length(first_line) <= 80 then first_line else substr(first_line, 1, 79) || '…' end
        when tool = 'Grep' then 'matches=' || n_lines || '; files=' || p
        when tool = 'Edit' then 'path=' || p || '; result=' || case when length(first_line) <= 100 then first_line else substr(first_line, 1, 99) || '…' end
        when tool = 'WebFetch' then 'url=https://example.org/' || k || '; head=' || h120
        else 'cmd=run ' || k || '; lines=' || n_lines || '; files=' || p || '; head=' || h100 || '; tail=' || t60 end as line
    from l
)
select session_id, call_seq, tool, case when length(line) <= 240 then line else substr(line, 1, 239) || '…' end as sketch from s"""
)


@query(_SKETCHES)
def sketch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = sketch.sketch(F.col("tool"), F.col("input"), F.col("result"), F.col("is_error"))
    return _calls(spark, sf_dir).select("session_id", "call_seq", "tool", line.alias("sketch"))


@query()
def redact_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redact(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", ["doc_id"], "text")
    return rows.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), "secrets")


# ---- search


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


_WORDS = lambda listed: ", ".join(f"'{w}'" for w in listed)
_TERM_RE = terms.TERM.replace("'", "''")
_QUERY_TERMS = f"""
qt as (select item_id as query_id, text, list_distinct(regexp_extract_all(lower(text), '{_TERM_RE}')) as own from benchmark),
q1 as (select query_id, unnest(own) as t from qt),
q2 as (select query_id, t from q1 where length(t) >= 3 and t not in ({_WORDS(terms.STOP_WORDS)})),
q3 as (select query_id, t, case when regexp_matches(t, '[_.\\-/\\\\0-9]') then t when length(t) >= 6 and ends_with(t, 'ing') then substr(t, 1, length(t) - 3) when length(t) >= 5 and ends_with(t, 'ed') then substr(t, 1, length(t) - 2)
    when length(t) >= 5 and ends_with(t, 'es') and not ends_with(t, 'ses') then substr(t, 1, length(t) - 1) when length(t) >= 4 and ends_with(t, 's') and not ends_with(t, 'ss') then substr(t, 1, length(t) - 1) else t end as st from q2),
q4 as (select query_id, t as term from q2 union select query_id, st from q3 where length(st) >= 3)"""


@query(f"with {_QUERY_TERMS} select query_id, count(*) as terms, sha256(string_agg(term, ',' order by term)) as terms_sha256 from q4 group by 1")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prompts(spark, sf_dir).select("query_id", F.array_sort(terms.query_terms(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    return rows.select("query_id", F.size("t").cast("long").alias("terms"), F.sha2(F.array_join("t", ","), 256).alias("terms_sha256"))


# The tables' words have no separators but a stop at a sentence's end, so codes come from capitals and joined parts only.
_RANK = (
    f"with {_QUERY_TERMS},"
    + f"""
cr as (select item_id as query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$][A-Za-z0-9_$.\\-/\\\\]*')) as raw0 from benchmark),
cr1 as (select query_id, regexp_replace(raw0, '[.:,;]+$', '') as raw from cr),
code as (select distinct query_id, lower(raw) as term from cr1 where length(raw) >= 2 and (regexp_matches(raw, '[a-z][A-Z]') or (regexp_matches(raw, '^[A-Z0-9_$]{{3,}}$') and regexp_matches(raw, '[A-Z]')) or (regexp_matches(raw, '[A-Za-z0-9][_$./\\\\\\-][A-Za-z0-9$]') and not regexp_matches(raw, '^[0-9.\\-/]+$')) or (regexp_matches(raw, '[0-9]') and not regexp_matches(raw, '[A-Za-z]') and length(raw) >= 3))),
comp as (select distinct query_id, x as term from (select query_id, term as whole, unnest(regexp_split_to_array(term, '[_$./\\\\\\-]+')) as x from code) where length(x) >= 4 and x <> whole and x not in ({_WORDS(terms.STOP_WORDS)})),
qa as (select query_id, term from q4 union select query_id, term from comp),
asked as (select qa.query_id, qa.term, c.term is not null as code, c.term is not null or (o.t is not null and qa.term not in ({_WORDS(terms.PROSE_WORDS)})) as eligible
    from qa left join code c using (query_id, term) left join (select distinct query_id, t from q1) o on o.query_id = qa.query_id and o.t = qa.term),
rec as (select cast(doc_id as varchar) as id, source as session_id, doc_id as seq, lang, coalesce(text, '') as content from documents qualify row_number() over (partition by source, sha256(coalesce(text, '')) order by doc_id desc) = 1),
tok as (select session_id, id, unnest(list_distinct(regexp_extract_all(lower(content), '{_TERM_RE}'))) as token from rec),
meta as (select session_id, id, unnest(list_distinct(regexp_extract_all(lower(lang || ' {{"tool":"' || lang || '"}}'), '{_TERM_RE}'))) as term from rec),
voc as (select distinct token from tok), wanted as (select distinct term from qa),
kind as (select term, token, case when term = token then 1.0 when length(term) < 4 then null when contains('/' || regexp_replace(token, '[_.\\-/\\\\]', '/', 'g') || '/', '/' || regexp_replace(term, '[_.\\-/\\\\]', '/', 'g') || '/') then 0.9 when length(term) >= 5 then 0.4 end as weight from wanted join voc on contains(token, term)),
mc as (select session_id, id, term, max(cast(weight as double)) as weight, false as in_meta from tok join kind using (token) where weight is not null group by all),
mm as (select session_id, id, term, 1e0 as weight, true as in_meta from meta join wanted using (term)),
mt as (select session_id, id, term, max(weight) as weight, bool_or(in_meta) as in_meta from (select * from mc union all select * from mm) group by all),
n as (select session_id, count(*) as n from rec group by 1),
df as (select session_id, term, count(*) as df from mt where weight >= 0.9 or in_meta group by all),
w as (select asked.*, n.session_id, n.n, coalesce(df.df, 0) as df, (case when code then 3e0 else 1e0 end) * ln(1 + n.n / cast(1 + coalesce(df.df, 0) as double)) as w from asked cross join n left join df on df.session_id = n.session_id and df.term = asked.term),
tot as (select query_id, session_id, sum(w) as total from w group by all),
sc as (select w.query_id, w.session_id, mt.id, sum((case when mt.in_meta then 1.2e0 else mt.weight end) * w.w) as hits, bool_or(w.eligible and (mt.weight >= 0.9 or mt.in_meta)) as anchored, bool_or(w.eligible and (mt.weight >= 0.9 or mt.in_meta) and w.df <= greatest(3, ceil(w.n * 0.1))) as rare from w join mt using (session_id, term) group by all),
ranked as (select query_id, session_id, id, case when rare then greatest(0.5, least(1e0, hits / total)) else least(1e0, hits / total) end as score0 from sc join tot using (query_id, session_id) where anchored and hits > 0),
final as (select query_id, session_id, id, seq, round(score0, 6) as score from ranked join rec using (session_id, id))"""
)


@query(_RANK + " select session_id, term, df from df")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.numbered(search.query_rows(_prompts(spark, sf_dir)))
    return search.frequencies(search.marked(_archive(spark, sf_dir), wanted)).filter("df > 0").join(wanted, "term_no").select("session_id", "term", "df")


@query(_RANK + " select query_id, session_id, id, seq, score from final")
def rank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_records(_prompts(spark, sf_dir), _archive(spark, sf_dir)).select("query_id", "session_id", "id", "seq", "score")


@query(_RANK + ", top as (select *, row_number() over (partition by query_id, session_id order by score desc, seq desc) as rank from final) select query_id, session_id, id, seq, score, rank from top where rank <= 20")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_topk(_prompts(spark, sf_dir), _archive(spark, sf_dir), 20).select("query_id", "session_id", "id", "seq", "score", "rank")


@query(_RANK + ", top as (select *, row_number() over (partition by query_id, session_id order by score desc, seq desc) as rank from final) select query_id, session_id, id, seq, score, rank from top where rank <= 20 and session_id = 'src' || (query_id % 20)")
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_topk() for prompts that belong to one session each."""
    prompts = _prompts(spark, sf_dir).withColumn("session_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return search.search_topk(prompts, _archive(spark, sf_dir), 20).select("query_id", "session_id", "id", "seq", "score", "rank")


@query()
def rehydrate_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.rehydrate(_prompts(spark, sf_dir), _archive(spark, sf_dir), CONFIG.rehydrate)


# ---- fitting, evals, trigger


@query(f"with {_TURNS}, u as (select *, row_number() over (partition by session_id order by message_index desc) as age from m where role = 'user' and trim(text) <> '') select session_id, string_agg(case when length(trim(text)) <= 500 then trim(text) else substr(trim(text), 1, 499) || '…' end, chr(10) order by message_index) as goal from u where age <= 3 group by 1")
def goal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.goal_text(_turns(spark, sf_dir))


@query()
def fit_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _written_session(spark, sf_dir)
    return fit.fit_state(messages, ledger.tool_calls(messages, CONFIG.preserve_recent), 2_000, CONFIG.preserve_recent)


@query(
    f"with recursive {_CALLS}, q as (select session_id, call_seq, {_tokens('input')} + {_tokens('tool')} + 20 as tokens from c), f as (select session_id, call_seq, tokens, cast(0 as int) as batch, tokens as used from q where call_seq = 1 union all select q.session_id, q.call_seq, q.tokens, cast(f.batch + case when f.used + q.tokens > 400 then 1 else 0 end as int), case when f.used + q.tokens > 400 then q.tokens else f.used + q.tokens end from f join q on q.session_id = f.session_id and q.call_seq = f.call_seq + 1) select session_id, call_seq, tokens, batch from f"
)
def batch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.batch_calls(_calls(spark, sf_dir), 400)


def _asker(state: str, questions: list[dict]) -> dict:
    """Answers by a call's number; fails for requests that begin with a call of a number that ends in 3."""
    if questions[0]["call"] % 10 == 3:
        raise ConnectionError("no answer")
    return {q["call"]: ((q["call"] * 7 % 100) / 100, (q["call"] * 13 % 100) / 100) for q in questions}


@query(
    SQL["batch_calls"].replace("400", "700").replace("select session_id, call_seq, tokens, batch from f", "", 1).rstrip()
    + ", b as (select session_id, batch, min(call_seq) % 10 = 3 as failed from f group by 1, 2) "
    "select session_id, call_seq, batch, failed as unscored, case when not failed then round(call_seq * 7 % 100 / 100.0, 6) end as keep_call, case when not failed then round(call_seq * 13 % 100 / 100.0, 6) end as keep_result from f join b using (session_id, batch)"
)
def asked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a batched asker that fails at some requests: their calls are unscored, all others have answers. The state has what the request leaves free of 700 tokens."""
    messages = _written_session(spark, sf_dir)
    calls = table(ledger.tool_calls(messages, CONFIG.preserve_recent).select("session_id", "call_seq", "tool", "input", "result_chars", "is_error", "call_index"), "calls")
    states = fit.fitted_states(messages, calls, 2_000, CONFIG.preserve_recent).withColumn("tokens", F.lit(0)).withColumn("state", F.coalesce("state", F.lit("{}")))
    made = asking.replies(asking.requests(states, calls, 700), _asker, asking.AskOptions())
    answers = made.select("session_id", F.inline("answers"))
    packed = fit.batch_calls(calls, 700).select("session_id", "call_seq", "batch")
    rows = packed.join(answers, ["session_id", "call_seq"], "left")
    return rows.select("session_id", "call_seq", "batch", F.col("keep_call").isNull().alias("unscored"), F.round("keep_call", 6).alias("keep_call"), F.round("keep_result", 6).alias("keep_result"))


@query("select item_id as probe_id, count(doc_id) as texts, min(doc_id) as first_text from benchmark left join documents on contains(documents.text, benchmark.text) group by 1")
def probe_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.probe_retention(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


_LABELS = "case when k % 10 = 0 then 'must_keep' when k % 10 < 4 then 'safe_to_truncate' else 'safe_to_drop' end"
_OUTCOMES = "case when action in ('PIN_VERBATIM', 'KEEP_VERBATIM') then 'verbatim' when action in ('ARCHIVE_ONLY', 'DROP_REDUNDANT') then 'dropped' else 'truncated' end"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(k % 10 == 0, "must_keep").when(k % 10 < 4, "safe_to_truncate").otherwise("safe_to_drop")
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("tool_use_id"), label.alias("label"))


@query(f"with {_SCORES}{_decided('0.4e0')}, o as (select session_id, {_LABELS} as label, {_OUTCOMES} as outcome from v) select session_id, label, count(*) as calls, count(*) filter (outcome = 'verbatim') as verbatim, count(*) filter (outcome = 'truncated') as truncated, count(*) filter (outcome = 'dropped') as dropped from o group by all")
def fidelity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.fidelity(_decisions(spark, sf_dir), _labels(spark, sf_dir))


@query(
    f"with {_SCORES}{_decided('0.4e0')}, why as (select session_id, case when pinned then ['pinned_window'] when len(protections) > 0 then protections when copy_seq is not null then ['duplicate'] "
    "else ['classifier_result'] || case when weak > 0 then ['referenced_weakly'] else [] end || case when br >= t then [] else ['classifier_call'] end || case when br < t and keep_call >= t and tool in ('Read', 'Grep') and not changed then ['rerunnable'] else [] end end as codes from v) "
    "select session_id, reason, count(*) as calls from (select session_id, unnest(codes) as reason from why) group by all"
)
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reason_counts(_decisions(spark, sf_dir))


@query(
    f"with {_CALLS}, i as (select session_id, 0 as rank, 0 as call_seq, 'p' || n as item_id, 'probe ' || n as text from e where n < 3 "
    "union all select session_id, case when k % 10 = 0 then 1 else 2 end, call_seq, 'call:' || tool_use_id, substr(result, 1, 300) || ' (tool ' || tool || ', input ' || input || ')' from c where k % 10 = 0 or k % 10 >= 4), "
    "p as (select *, row_number() over (partition by session_id, rank order by call_seq, item_id) - 1 as p, greatest(0, 40 - count(*) filter (rank < 2) over (partition by session_id)) as room, count(*) filter (rank = 2) over (partition by session_id) as n from i), "
    "x as (select * from p where rank < 2 or n <= room or list_contains(list_transform(range(room), lambda i: i * n // room), p)), "
    "o as (select *, row_number() over (partition by session_id order by rank, p) as place from x) "
    "select session_id, cast(place as int) as place, item_id, case rank when 0 then 'probe' when 1 then 'call' else 'drop' end as kind, text from o where place <= 40"
)
def judge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    n = (F.col("call_seq") - 1).cast("string")
    probes = calls.filter("call_seq <= 3").select("session_id", F.concat(F.lit("p"), n).alias("probe_id"), F.concat(F.lit("probe "), n).alias("probe"))
    return evals.judge_items(probes, _labels(spark, sf_dir), calls)


@query(
    "with e as (select cast(user_id as varchar) as session_id, cast(json_extract_string(props, '$.k') as int) as k from events), "
    "j as (select session_id, k % 3 as kind, case when k % 4 = 0 then null when k % 5 = 0 then 'absent' when k % 5 = 1 then 'paraphrased' else 'present' end as present from e), "
    "i as (select *, coalesce(present, 'absent') as seen from j) "
    "select session_id, count(*) filter (kind = 0) as must_keep_total, count(*) filter (kind = 0 and seen = 'absent') as must_keep_absent, count(*) filter (kind = 1) as probes_total, count(*) filter (kind = 1 and seen = 'absent') as probes_absent, "
    "count(*) filter (kind = 1 and seen = 'paraphrased') as probes_paraphrased, count(*) filter (kind = 2) as safe_to_drop_total, count(*) filter (kind = 2 and seen <> 'absent') as safe_to_drop_present, count(*) filter (present is null) as missing_verdicts from i group by 1"
)
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of three kinds, and replies of a judge that has words around its JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("item_id"), k.alias("k"))
    items = rows.withColumn("kind", F.element_at(F.array(F.lit("call"), F.lit("probe"), F.lit("drop")), F.col("k") % 3 + 1))
    said = F.when(F.col("k") % 5 == 0, "absent").when(F.col("k") % 5 == 1, "paraphrased").otherwise("Present")
    reply = F.concat(F.lit('Here it is:\n```json\n{"verdicts":[{"id":"'), F.col("item_id"), F.lit('","present":"'), said, F.lit('"}]}\n``` as asked'))
    return evals.judge_summary(items, evals.verdicts_of(rows.filter("k % 4 <> 0").select("session_id", reply.alias("text"))))


@query(
    " union all ".join(
        f"select * from (with {_SCORES}{_decided(f'{t}e0')}, o as (select session_id, sum(length(result)) as before, sum(length(result)) filter (action not in ('PIN_VERBATIM', 'KEEP_VERBATIM')) as gone, count(*) filter ({_LABELS} = 'must_keep' and {_OUTCOMES} = 'dropped') as lost from v group by 1) select 'ruleset-{t}' as mode, count(*) as cases, count(*) as scored, 0 as failures, round(avg(coalesce(gone, 0) / cast(before as double)), 6) as mean_reduction, cast(sum(lost) as bigint) as must_keep_dropped from o)"
        for t in (0.3, 0.4, 0.5)
    )
)
def mode_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, labels = _decisions(spark, sf_dir).drop("action", "codes", "confidence"), _labels(spark, sf_dir)
    results = None
    for t in (0.3, 0.4, 0.5):
        rows = evals.call_outcomes(scoring.decide(scored, PolicyOptions(threshold=t))).join(labels, ["session_id", "tool_use_id"])
        gone = F.sum(F.when(F.col("outcome") != "verbatim", F.col("result_chars")).otherwise(0))
        part = rows.groupBy("session_id").agg((gone / F.sum("result_chars")).alias("reduction"), F.count_if((F.col("label") == "must_keep") & (F.col("outcome") == "dropped")).alias("must_keep_dropped"))
        part = part.withColumn("mode", F.lit(f"ruleset-{t}")).withColumn("available", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
        results = part if results is None else results.unionByName(part)
    return evals.mode_aggregate(results)


@query(
    f"with recursive {_TURNS}, t as (select session_id, message_index as turn, {_tokens('text')} as tokens, row_number() over (partition by session_id order by message_index) as i from m), "
    "s as (select session_id, turn, i, sum(tokens) over (partition by session_id order by turn) as total from t), "
    "f as (select session_id, turn, i, total, total >= 300 as fire, case when total >= 300 then total else 0 end as attempted from s where i = 1 union all select s.session_id, s.turn, s.i, s.total, s.total >= 300 and (f.attempted = 0 or s.total >= 1.25 * f.attempted), case when s.total < 300 then 0 when f.attempted = 0 or s.total >= 1.25 * f.attempted then s.total else f.attempted end from f join s on s.session_id = f.session_id and s.i = f.i + 1) "
    "select session_id, cast(turn as bigint) as turn, cast(total as bigint) as total from f where fire"
)
def auto_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select("session_id", F.col("message_index").alias("turn"), text.estimate_tokens(F.col("text")).alias("tokens"))
    return trigger.auto_trigger(turns, 300)


# ---- time and state


def _timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


_TIMED = "t as (select cast(user_id as varchar) as session_id, cast(ts as timestamp) as ts, cast(json_extract_string(props, '$.k') as bigint) as tokens from events)"


@query(f"with {_TIMED} select session_id, cast(time_bucket(interval 1 day, ts) as varchar) as begins, count(*) as turns, cast(sum(tokens) as bigint) as tokens from t group by all")
def tokens_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.tokens_by_window(_timed_turns(spark, sf_dir), "1 day")
    return rows.select("session_id", F.date_format("begins", "yyyy-MM-dd HH:mm:ss").alias("begins"), "turns", "tokens")


@query(
    f"with {_TIMED}, g as (select *, case when ts < lag(ts) over (partition by session_id order by ts) + interval 6 hour then 0 else 1 end as f from t), "
    "i as (select *, sum(f) over (partition by session_id order by ts rows unbounded preceding) as n from g) "
    "select session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as begins, count(*) as turns, cast(sum(tokens) as bigint) as tokens from i group by session_id, n"
)
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.tokens_by_activity(_timed_turns(spark, sf_dir), "6 hours")
    return rows.select("session_id", F.date_format("begins", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("begins"), "turns", "tokens")


@query(f"with {_CALLS} select session_id, 'call ' || max(n) as compaction, max(n) as version from e where k % 3 = 0 group by 1")
def last_compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of the states that two writers upsert, one of them twice, after they were merged half way."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.row_number().over(order) - 1).cast("long").alias("version"))
    rows = rows.filter("k % 3 = 0").select("session_id", F.lit(state.LAST).alias("name"), F.concat(F.lit("call "), F.col("version").cast("string")).alias("value"), "version")
    store = state.StateTable(spark, fresh_path(spark, "state"))
    store.upsert(rows.filter("version % 2 = 1"), "odd")
    store.merge()
    for _ in range(2):
        store.upsert(rows.filter("version % 2 = 0"), "even")
    return store.last_compactions()
