"""A second look at compactions that keep nothing: what a reviewer is shown, and what its reply says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sketch import sketch
from ..functions.text import SPACE, estimate_tokens, input_summary
from .scoring import suspect_calibration

#: How a reviewer may decide.
VERDICTS = ("drop_all", "keep_some", "unsure")


def review_candidates(decisions: DataFrame, least: int = 5) -> DataFrame:
    """Calls that suspect sessions would lose after being scored: session_id, tool_use_id, tool, about, tokens, keep_call, keep_result, sketch."""
    scored = F.exists("codes", lambda c: c.startswith("classifier_"))
    rows = decisions.filter(scored & (F.col("action") != "KEEP_VERBATIM")).join(suspect_calibration(decisions, least).select("session_id"), "session_id", "left_semi")
    short = F.trim(F.regexp_replace(sketch(F.col("tool"), F.col("input"), F.col("result"), F.col("is_error")), SPACE + "+", " "))
    return rows.select("session_id", "call_seq", "tool_use_id", "tool", input_summary(F.col("input")).alias("about"), estimate_tokens(F.col("result")).alias("tokens"), "keep_call", "keep_result", short.alias("sketch"))


def review_questions(candidates: DataFrame, threshold: float) -> DataFrame:
    """Per session one text that lists its candidates and says how to reply: session_id, candidates, question."""
    line = F.format_string("- %s: %s %s, about %d tokens, result scored %.2f: %s", "tool_use_id", "tool", "about", "tokens", F.coalesce("keep_result", F.lit(0.0)), "sketch")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_seq", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.lit(f"All of these results scored below {threshold} and would leave the conversation; each can be brought back by its id. Name those whose exact content the next turns need.\n")
    tail = F.lit('\nReply in JSON alone: {"verdict": "drop_all", "keep_some" or "unsure", "keep": [ids], "reason": "one sentence"}')
    return candidates.groupBy("session_id").agg(F.count("*").alias("candidates"), F.concat(head, listed, tail).alias("question"))


def parse_reviews(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """What reviewers' replies (session_id, text; one a session) say: session_id, verdict, keep (ids), reason.

    The JSON is looked for between the first and the last brace.  A reply
    without a usable verdict has a null one.  Ids that aren't candidates are
    left out; a reply that keeps some but names none that is known is unsure.
    """
    parsed = F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), "verdict string, keep array<string>, reason string")
    rows = replies.select("session_id", parsed.alias("p")).select("session_id", F.when(F.col("p.verdict").isin(*VERDICTS), F.col("p.verdict")).alias("verdict"), "p.keep", F.substring(F.trim(F.regexp_replace(F.coalesce("p.reason", F.lit("")), SPACE + "+", " ")), 1, 300).alias("reason"))
    named = rows.filter("verdict = 'keep_some'").select("session_id", F.posexplode("keep").alias("at", "tool_use_id"))
    known = named.join(candidates.select("session_id", "tool_use_id").distinct(), ["session_id", "tool_use_id"], "left_semi")
    known = known.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tool_use_id"))), lambda x: x["tool_use_id"]).alias("known"))
    rows = rows.drop("keep").join(known, "session_id", "left")
    none = (F.col("verdict") == "keep_some") & F.col("known").isNull()
    reason = F.when(none & (F.col("reason") == ""), "asked to keep some but named none").otherwise(F.col("reason"))
    return rows.select("session_id", F.when(none, "unsure").otherwise(F.col("verdict")).alias("verdict"), F.coalesce("known", F.array().cast("array<string>")).alias("keep"), F.when(F.col("verdict").isNotNull(), reason).alias("reason"))


def kept_by_review(reviews: DataFrame) -> DataFrame:
    """session_id, tool_use_id of the calls that reviewers want kept, for scoring.apply_review()."""
    return reviews.select("session_id", F.explode("keep").alias("tool_use_id"))
