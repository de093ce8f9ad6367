"""References from later events to earlier tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import GraphOptions
from ..functions.text import errors_in, paths_in, quotes_in, symbols_of, tool_ids_in, truncate

#: Of two events' several common anchors, the first of these kinds makes the edge.
KINDS = ("path", "error", "quote", "symbol", "tool_id")


def _shape(name: F.Column) -> F.Column:
    """What equal names have in common and is cheap to tell: the first letter and the length."""
    return F.concat(F.substring(name, 1, 1), F.length(name).cast("string"))


def _anchors(content, words, ids, options: GraphOptions) -> F.Column:
    kinds = [("path", paths_in(content)), ("error", errors_in(content)), ("quote", quotes_in(content, options.quote_length, options.max_quotes)), ("symbol", symbols_of(words, options.symbol_length, options.max_symbols)), ("tool_id", ids)]

    def marked(rank: int, kind: str, found: F.Column) -> F.Column:
        return F.transform(found, lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("via"), i.alias("pos"), x.alias("fragment")))

    return F.concat(*[marked(n, k, a) for n, (k, a) in enumerate(kinds)])


def _met(events: DataFrame, options: GraphOptions) -> DataFrame:
    """A row for each anchor that a later event has in common with a result."""
    is_result = F.col("kind") == "tool_result"
    session = Window.partitionBy("session_id")
    before = session.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    events = events.select("session_id", "event_id", "seq", "kind", "content", "tool_use_id", "message_index")
    events = events.withColumns({"age": F.count_if(is_result).over(session) - F.count_if(is_result).over(before), "shapes": F.collect_set(F.when(is_result, _shape(F.col("tool_use_id")))).over(session)})
    events = events.filter(~is_result | (F.col("age") <= options.max_results))
    # Of an event's words only those shaped like the id of a result of its session can be one; the others would be most of all anchors.
    events = events.withColumn("words", tool_ids_in(F.col("content")))
    ids = F.when(is_result, F.array("tool_use_id")).otherwise(F.filter("words", lambda w: F.array_contains("shapes", _shape(w))))
    events = events.select("session_id", "event_id", "seq", "kind", "message_index", _anchors(F.col("content"), F.col("words"), ids, options).alias("anchors"))
    # Outer, then without its nulls: of inline() Spark makes a filter that looks for all anchors twice more.
    anchors = events.select("session_id", "event_id", "seq", "kind", "message_index", F.inline_outer("anchors")).filter("fragment is not null")
    # Events meet the results of their anchor in a window, which keeps the session's partitioning: at most max_results of them.
    same = Window.partitionBy("session_id", "via", "fragment")
    result = F.struct(F.col("event_id").alias("to_id"), F.col("seq").alias("to_seq"), F.col("message_index").alias("to_index"), "rank")
    met = anchors.withColumn("to", F.collect_list(F.when(is_result, result)).over(same)).filter(~is_result & (F.size("to") > 0) & ((F.col("via") != "symbol") | (F.size("to") <= options.results_per_symbol)))
    met = met.select("session_id", F.col("event_id").alias("from_id"), F.col("kind").alias("from_kind"), "seq", "message_index", "pos", "via", "fragment", F.explode("to").alias("r")).select("*", "r.to_id", "r.to_seq", "r.to_index", "r.rank")
    return met.filter((F.col("seq") > F.col("to_seq")) & ((F.col("from_kind") == "user_text") | (F.col("message_index") - F.col("to_index") > options.message_gap)))


def dependency_edges(events: DataFrame, options: GraphOptions | None = None) -> DataFrame:
    """One edge per pair of a later event and a result with a common anchor: session_id, from_id, to_id, from_kind, via, fragment.

    A user's text counts at any distance, other events beyond message_gap
    messages.  Symbols of more than a few results refer to none.
    """
    # The first kind, then the first place.
    first = F.min(F.struct("rank", "pos", "via", "fragment"))
    met = _met(events, options or GraphOptions())
    return met.groupBy("session_id", "from_id", "to_id", "from_kind", "seq").agg(first.alias("e")).select("session_id", "from_id", "to_id", "from_kind", "seq", F.col("e.via").alias("via"), truncate(F.col("e.fragment"), 120).alias("fragment"))


def reference_strength(edges: DataFrame) -> DataFrame:
    """Per result: how many references are strong (a user's text, or an error, quote or id), and how many weak; weak ones don't count beside strong."""
    strong = (F.col("from_kind") == "user_text") | F.col("via").isin("error", "quote", "tool_id")
    rows = edges.groupBy("session_id", "to_id").agg(F.count_if(strong).alias("strong"), F.count_if(~strong).alias("weak"))
    return rows.withColumn("weak", F.when(F.col("strong") > 0, F.lit(0)).otherwise(F.col("weak")))


def references_of_calls(events: DataFrame, options: GraphOptions | None = None) -> DataFrame:
    """session_id, tool_use_id, strong, weak for the results that are referred to."""
    # A session's events are told apart by seq as well: no hashes of contents, and no window over them.
    events = events.withColumn("event_id", F.col("seq"))
    # Which kind makes an edge is all that counts here, so edges are grouped by numbers, without their fragments.
    edges = _met(events, options or GraphOptions()).groupBy("session_id", "from_id", "to_id", "from_kind").agg(F.min("rank").alias("rank"))
    strengths = reference_strength(edges.withColumn("via", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)))
    results = events.filter("kind = 'tool_result'").groupBy("session_id", "tool_use_id").agg(F.max("event_id").alias("to_id"))
    return results.join(strengths, ["session_id", "to_id"]).select("session_id", "tool_use_id", "strong", "weak")
