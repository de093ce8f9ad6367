"""How well a compaction kept what matters: probes, labels, structure, and sums by mode."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import truncate
from ..storage import ready, table
from .rebuild import structure_faults
from .scoring import DROPS_CALL

#: Bytes of probes that one automaton takes; a larger set is several, and texts are read once for each.
PROBE_BYTES = 4 << 20


def probe_matches(probes: DataFrame, texts: DataFrame, probe: str, text_id: str, text: str) -> DataFrame:
    """probe, text_id of each distinct probe (not empty) and text that contains it.

    The stated set of probes is made into automata, of which each takes a
    bounded part of them to the tasks; a text is walked once for all probes of
    one, so time hardly depends on their number.
    """
    spark = ready(texts.sparkSession)
    own = table(probes.select(F.col(probe).alias("probe")).filter("probe <> ''").distinct(), "probes")
    size = own.agg(F.sum(F.octet_length("probe"))).first()[0] or 0
    parts = -(-size // PROBE_BYTES)
    rows = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("content")).filter("content is not null")
    kind = to_arrow_type(rows.schema["text_id"].dataType)
    schema = pa.schema([("probe", pa.string()), ("text_id", kind)])
    found = spark.createDataFrame([], StructType([StructField("probe", StringType()), rows.schema["text_id"]]))
    for part in range(parts):
        given = spark.sparkContext.broadcast([r[0] for r in own.filter(F.pmod(F.xxhash64("probe"), F.lit(parts)) == part).collect()])  # about PROBE_BYTES

        def run(batches, given=given):
            automaton = ahocorasick.Automaton()
            for x in given.value:
                automaton.add_word(x, x)
            automaton.make_automaton()
            for b in batches:
                hits, at = [], []
                for i, content in enumerate(b.column(1).to_pylist()):
                    met = {x for _, x in automaton.iter(content)}
                    hits += met
                    at += [i] * len(met)
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), b.column(0).take(pa.array(at, pa.int64()))], schema=schema)

        if given.value:
            found = found.unionByName(rows.mapInArrow(run, found.schema))
    return found


def probe_retention(probes: DataFrame, texts: DataFrame, probe_id: str, probe_text: str, text_id: str, text: str) -> DataFrame:
    """Per probe, how many texts contain it, and the first of them; a null probe is in none, an empty one in all that aren't null."""
    counts = lambda df: df.agg(F.count("*").alias("texts"), F.min("text_id").alias("first_text"))
    found = counts(probe_matches(probes, texts, probe_text, text_id, text).groupBy("probe"))
    everywhere = counts(texts.filter(F.col(text).isNotNull()).select(F.col(text_id).alias("text_id"))).select(F.lit("").alias("probe"), "*")
    found = found.unionByName(everywhere).withColumnRenamed("probe", "_probe")
    base = probes.select(F.col(probe_id).alias("probe_id"), F.col(probe_text).alias("_own"))
    return base.join(found, F.col("_own") == F.col("_probe"), "left").select("probe_id", F.coalesce("texts", F.lit(0)).alias("texts"), "first_text")


def call_outcomes(decisions: DataFrame) -> DataFrame:
    """decisions with outcome: verbatim, truncated or dropped."""
    kept = F.col("action").isin("PIN_VERBATIM", "KEEP_VERBATIM")
    return decisions.withColumn("outcome", F.when(kept, "verbatim").when(F.col("action").isin(*DROPS_CALL), "dropped").otherwise("truncated"))


def fidelity(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per session and label (must_keep, nice_to_keep, safe_to_truncate, safe_to_drop): calls by outcome."""
    rows = call_outcomes(decisions).join(labels, ["session_id", "tool_use_id"])
    return rows.groupBy("session_id", "label").agg(F.count("*").alias("calls"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("verbatim", "truncated", "dropped")])


def structure_valid(messages: DataFrame) -> DataFrame:
    """Per session, whether every result has its use at or before its message: structure_faults() counted, in one pass that keeps a partitioning by session."""
    seen = lambda array, is_result: F.transform(F.coalesce(array, F.array()), lambda x: F.struct(x["tool_use_id"].alias("tool_use_id"), F.lit(is_result).alias("is_result")))
    rows = messages.select("session_id", "message_index", F.inline_outer(F.concat(seen(F.col("tool_uses"), False), seen(F.col("tool_results"), True))))
    # Rows without an id have no use, and are together by message only.
    same = Window.partitionBy("session_id", "tool_use_id", F.when(F.col("tool_use_id").isNull(), F.col("message_index")))
    first = F.min(F.when(~F.col("is_result") & F.col("tool_use_id").isNotNull(), F.col("message_index"))).over(same)
    fault = F.col("is_result") & (F.col("first").isNull() | (F.col("first") > F.col("message_index")))
    return rows.withColumn("first", first).groupBy("session_id").agg(F.count_if(fault).alias("faults")).select("session_id", "faults", (F.col("faults") == 0).alias("valid"))


def order_and_verbatim(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per session of after: messages that kept their place and text, and those that changed."""
    old = before.select("session_id", "message_index", F.col("text").alias("old"))
    rows = after.join(old, ["session_id", "message_index"], "left")
    return rows.groupBy("session_id").agg(F.count_if(F.col("text") == F.col("old")).alias("same"), F.count_if(~F.col("text").eqNullSafe(F.col("old"))).alias("changed"))


def mode_aggregate(results: DataFrame) -> DataFrame:
    """Per mode, means and sums over the results that are available and without error."""
    ok = F.col("available") & F.col("error").isNull()
    return results.groupBy("mode").agg(
        F.count("*").alias("cases"),
        F.count_if(ok).alias("scored"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.round(F.avg(F.when(ok, F.col("reduction"))), 6).alias("mean_reduction"),
        F.sum(F.when(ok, F.col("must_keep_dropped"))).alias("must_keep_dropped"),
    )


def sampled(rows: DataFrame, session: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each session, evenly spaced in order."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(session))
    rows = rows.withColumn("_p", place).withColumn("_n", n)
    step = F.col("_n") / F.lit(float(most))
    rows = rows.withColumn("_k", F.ceil(F.col("_p") / step).cast("int"))
    chosen = (F.col("_n") <= most) | ((F.floor(F.col("_k") * step) == F.col("_p")) & (F.col("_k") < most))
    return rows.filter(chosen).drop("_p", "_n", "_k")


def message_blobs(messages: DataFrame) -> DataFrame:
    """session_id, message_index, blob: all that a message has to search in, its text, inputs and results, a line break between them."""
    uses, results = F.transform("tool_uses", lambda u: u["input"]), F.transform("tool_results", lambda r: F.coalesce(r["text"], F.lit("")))
    return messages.select("session_id", "message_index", F.array_join(F.concat(F.array("text"), uses, results), "\n").alias("blob"))


def probes_by_place(probes: DataFrame, messages: DataFrame, archive: DataFrame) -> DataFrame:
    """probes (session_id, probe_id, probe, place) with active (some message of its session has it), archived, and held: where its place asks for it, active or active_or_archive.

    A probe is looked for in each message and record of its own session, not across two of them.
    """
    own = probes.select("session_id", "probe_id", "probe", "place")

    def met(texts: DataFrame, content: str, name: str) -> DataFrame:
        rows = texts.select(F.col("session_id").alias("_s"), content).join(own.select("session_id", "probe").distinct(), F.col("_s") == F.col("session_id"))
        return rows.filter(F.contains(content, F.col("probe"))).select("session_id", "probe").distinct().withColumn(name, F.lit(True))

    rows = own.join(met(message_blobs(messages), "blob", "active"), ["session_id", "probe"], "left").join(met(archive, "content", "archived"), ["session_id", "probe"], "left").na.fill(False, ["active", "archived"])
    return rows.withColumn("held", F.col("active") | ((F.col("place") == "active_or_archive") & F.col("archived")))


#: What a judge is asked about a case at most.
ITEMS = 40


def judge_items(probes: DataFrame, labels: DataFrame, calls: DataFrame, most: int = ITEMS) -> DataFrame:
    """What a judge is asked about each session: session_id, place, item_id, kind (probe, call, drop), text.

    Probes (session_id, probe_id, probe) come first, then calls labelled
    must_keep; what room is left goes to an even sample of those that are safe to
    drop.  Calls are in order; labels of calls that aren't there ask nothing.
    """
    asked = labels.filter("label in ('must_keep', 'safe_to_drop')").join(calls.select("session_id", "tool_use_id", "call_seq", "tool", "input", "result"), ["session_id", "tool_use_id"])
    shown = F.concat(F.substring("result", 1, 300), F.lit(" (tool "), F.col("tool"), F.lit(", input "), truncate(F.col("input"), 200), F.lit(")"))
    asked = asked.select("session_id", F.when(F.col("label") == "must_keep", 1).otherwise(2).alias("rank"), "call_seq", F.concat(F.lit("call:"), F.col("tool_use_id")).alias("item_id"), shown.alias("text"))
    items = probes.select("session_id", F.lit(0).alias("rank"), F.lit(0).alias("call_seq"), F.col("probe_id").alias("item_id"), F.col("probe").alias("text")).unionByName(asked)
    place = F.row_number().over(Window.partitionBy("session_id", "rank").orderBy("call_seq", "item_id")) - 1
    whole = Window.partitionBy("session_id")
    fixed = F.count_if(F.col("rank") < 2).over(whole)
    rows = items.withColumns({"_p": place, "_room": F.greatest(F.lit(0), most - fixed), "_n": F.count_if(F.col("rank") == 2).over(whole)})
    # Of n calls for room places, those numbered floor(i * n / room).
    room, n = F.nullif("_room", F.lit(0)), F.nullif("_n", F.lit(0))
    k = F.ceil(F.col("_p") * room / n)
    chosen = (F.col("rank") < 2) | (F.col("_n") <= F.col("_room")) | ((F.floor(k * n / room) == F.col("_p")) & (k < room))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("rank", "_p"))
    kind = F.when(F.col("rank") == 0, "probe").when(F.col("rank") == 1, "call").otherwise("drop")
    return rows.filter(chosen).withColumn("place", order).filter(F.col("place") <= most).select("session_id", "place", "item_id", kind.alias("kind"), "text")


def verdicts_of(replies: DataFrame) -> DataFrame:
    """session_id, item_id, present of judges' replies (session_id, text): the JSON between the first and the last brace, whatever is around it; a reply without any has no verdict."""
    json = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    parsed = F.from_json(json, "verdicts array<struct<id: string, present: string>>")
    return replies.select("session_id", F.inline(parsed["verdicts"])).select("session_id", F.col("id").alias("item_id"), F.lower("present").alias("present")).filter("item_id is not null")


def judge_summary(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per session, of judged items (session_id, item_id, kind: call, probe or drop): how many are absent, paraphrased or there against what was expected; an item without a verdict counts as absent."""
    given = verdicts.groupBy("session_id", "item_id").agg(F.max("present").alias("present"))
    rows = items.join(given, ["session_id", "item_id"], "left").withColumn("seen", F.coalesce("present", F.lit("absent")))
    call, probe, drop = (F.col("kind") == k for k in ("call", "probe", "drop"))
    absent = F.col("seen") == "absent"
    return rows.groupBy("session_id").agg(
        F.count_if(call).alias("must_keep_total"),
        F.count_if(call & absent).alias("must_keep_absent"),
        F.count_if(probe).alias("probes_total"),
        F.count_if(probe & absent).alias("probes_absent"),
        F.count_if(probe & (F.col("seen") == "paraphrased")).alias("probes_paraphrased"),
        F.count_if(drop).alias("safe_to_drop_total"),
        F.count_if(drop & ~absent).alias("safe_to_drop_present"),
        F.count_if(F.col("present").isNull()).alias("missing_verdicts"),
    )


def retrieval_check(needles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per session, of needles (session_id, needle_id, needle) that left the context: how many the retrieved blocks (session_id, block) bring back, and how many blocks have none."""
    own = needles.select("session_id", "needle_id", "needle").distinct()
    texts = blocks.select("session_id", F.monotonically_increasing_id().alias("n"), "block")
    met = own.join(texts, "session_id").filter(F.contains("block", F.col("needle")))
    found = met.select("session_id", "needle_id").distinct().groupBy("session_id").agg(F.count("*").alias("recovered"))
    useful = met.select("session_id", "n").distinct().groupBy("session_id").agg(F.count("*").alias("useful"))
    total, shown = own.groupBy("session_id").agg(F.count("*").alias("needles")), texts.groupBy("session_id").agg(F.count("*").alias("blocks"))
    rows = total.join(shown, "session_id", "full").join(found, "session_id", "left").join(useful, "session_id", "left").na.fill(0)
    return rows.select("session_id", "needles", "recovered", "blocks", (F.col("blocks") - F.col("useful")).alias("junk"))


def write_report(results: DataFrame, path: str) -> None:
    """Results of cases and their sums by mode, as JSON lines under path/cases and path/modes."""
    results.write.mode("overwrite").json(f"{path}/cases")
    mode_aggregate(results).write.mode("overwrite").json(f"{path}/modes")
