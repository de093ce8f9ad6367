"""The whole compaction: from messages to decisions, a rebuilt transcript, archive rows and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.redaction import redacted_sessions
from ..functions.text import tokens_in_all
from ..operators import graph, ledger, rebuild, rules, scoring
from ..storage import table


#: What a scorer may read of a call's texts, and the facts that hang on them: a session with secrets shows these redacted.
SHOWN = ("input", "canonical_input", "path", "raw_path", "command", "result", "result_chars", "resolved", "resolved_raw", "superseded")
_KEY = ["session_id", "call_seq"]
#: Texts of calls that their transcript has and nothing needs once actions are decided.
TEXTS = ("canonical_input", "raw_path", "result")


@dataclass
class Compaction:
    """Tables of one compaction; decisions (without TEXTS) are written, the others follow from them lazily. Write archive before publishing messages."""

    decisions: DataFrame
    messages: DataFrame
    archive: DataFrame
    report: DataFrame


def _redacted(messages: DataFrame, config: EngineConfig) -> DataFrame | None:
    """The sessions with secrets, redacted and written once; most tables have none, and then there is nothing to hide."""
    hidden = redacted_sessions(messages, user_paths=config.user_paths, extra=config.extra_secrets) if config.redact else None
    return None if hidden is None else table(hidden, "redacted")


def scored(protected: DataFrame, messages: DataFrame, config: EngineConfig, scorer: scoring.Scorer | None, hidden: DataFrame | None) -> DataFrame:
    """protected with scores, by a scorer that sees secrets of no session: calls of those in hidden are made anew from redacted messages.

    Pins, rules, references and the archive go by the originals.
    """
    if hidden is None:
        return scoring.RulesetScorer(config.ruleset).score(protected, messages) if scorer is None else scorer.score(protected)
    again = rules.with_facts(ledger.tool_calls(hidden, config.preserve_recent), config.rules.current_window)
    again = again.select(*_KEY, F.struct(*SHOWN).alias("_hidden"))
    own = F.struct(*SHOWN)
    both = protected.join(again, _KEY, "left").withColumn("_own", own).withColumn("_shown", F.coalesce("_hidden", own))
    view = both.select(*[c for c in protected.columns if c not in SHOWN], "_own", "_shown.*")
    if scorer is None:
        clean = messages.join(hidden.select("session_id").distinct(), "session_id", "left_anti")
        out = scoring.RulesetScorer(config.ruleset).score(view, clean.unionByName(hidden))
    else:
        out = scorer.score(view.drop("_own")).join(both.select(*_KEY, "_own"), _KEY)
    return out.drop(*SHOWN).select("*", "_own.*").drop("_own")


def decided(messages: DataFrame, config: EngineConfig, scorer: scoring.Scorer | None = None, references: bool = True, archive_ids: bool = False) -> DataFrame:
    """Calls with protections, duplicates, scores and actions, with archive_ids also the ids of their results' records. Runs a job for the secrets that a scorer must not see."""
    hidden, calls = _redacted(messages, config), ledger.tool_calls(messages, config.preserve_recent, archive_ids)
    plain = scorer is None and hidden is None
    if plain:  # before the windows of the rules, which then needn't sort any results
        calls = scoring.with_readings(calls, messages)
    found = graph.references_of_calls(ledger.ledger(messages), config.graph) if references else None
    protected = rules.with_protections(rules.exact_duplicates(calls), config.rules, found)
    out = scoring.decide(scored(protected, messages, config, scorer, hidden), config.policy)
    return out.drop(*scoring.READINGS) if plain else out


def compact(messages: DataFrame, config: EngineConfig | None = None, *, scorer: scoring.Scorer | None = None, compaction_id: str = "c_0", archived_at: str = "1970-01-01T00:00:00Z") -> Compaction:
    """One compaction of all sessions; its decisions are made and written when this is called."""
    config = config or EngineConfig()
    events = ledger.ledger(messages)
    decisions = table(decided(messages, config, scorer, archive_ids=True).drop(*TEXTS), "decisions")
    rebuilt = rebuild.apply_actions(messages, decisions, config)
    archive = rebuild.archive_rows(events, decisions, compaction_id, archived_at)
    return Compaction(decisions, rebuilt, archive, report(messages, rebuilt, decisions, config))


def accepted(before: DataFrame, made: Compaction) -> DataFrame:
    """The transcripts to go on with: rebuilt where the report accepts it, as they were elsewhere."""
    yes = made.report.filter("accepted").select("session_id")
    return made.messages.join(yes, "session_id", "left_semi").unionByName(before.join(yes, "session_id", "left_anti"))


def report(before: DataFrame, after: DataFrame, decisions: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Per session: messages and tokens before and after, the reduction, whether that is enough to accept it, counts of actions, and calls that a rule protected."""

    def size(messages: DataFrame, name: str) -> DataFrame:
        uses = F.transform("tool_uses", lambda u: F.concat(u["input"], F.coalesce(u["text"], F.lit(""))))
        texts = F.concat(F.array("text"), uses, F.transform("tool_results", lambda r: r["text"]))
        return messages.groupBy("session_id").agg(F.count("*").alias(f"messages_{name}"), F.sum(tokens_in_all(texts)).alias(f"tokens_{name}"))

    rows = size(before, "before").join(size(after, "after"), "session_id", "left").join(scoring.action_counts(decisions), "session_id", "left")
    protections = decisions.groupBy("session_id").agg(F.count_if(F.size("protections") > 0).alias("protected"))
    rows = rows.join(protections, "session_id", "left")
    ratio = F.when(F.col("tokens_before") == 0, F.lit(0.0)).otherwise(1 - F.coalesce("tokens_after", F.lit(0)) / F.col("tokens_before"))
    return rows.withColumn("reduction", F.round(ratio, 6)).withColumn("accepted", ratio >= (config or EngineConfig()).min_reduction)
