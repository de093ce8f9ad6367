"""A transcript's state fitted into a budget of tokens, and questions packed into requests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abridge, estimate_tokens, input_summary, token_tenths, truncate
from ..storage import ready, table
from .ledger import with_pins

#: Characters of an input that the stages show.
INPUTS = (1_000, 200, 60)
STAGES = ("full", "inputs<=200", "inputs<=60", "texts abridged", "old messages collapsed", "old calls compacted", "old messages left out", "old calls merged")


def goal_text(messages: DataFrame, newest: int = 3, most: int = 500) -> DataFrame:
    """Per session, the newest users' texts that carry no results, in order, a line each."""
    rows = messages.filter((F.col("role") == "user") & (F.trim("text") != "") & (F.size("tool_results") == 0))
    age = Window.partitionBy("session_id").orderBy(F.col("message_index").desc())
    rows = rows.withColumn("age", F.row_number().over(age)).filter(F.col("age") <= newest)
    listed = F.array_sort(F.collect_list(F.struct("message_index", truncate(F.trim("text"), most).alias("t"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("goal"))


def _calls(calls: DataFrame, most: int | None) -> Column:
    """A call as an entry shows it: its input cut to most characters, or with None one line."""
    note = F.concat(F.when(F.col("is_error"), F.lit("error, ")).otherwise(F.lit("ok, ")), F.col("result_chars").cast("string"), F.lit(" chars (omitted)"))
    if most is None:
        return F.concat_ws(" ", "tool", truncate(input_summary(F.col("input")), 60), F.when(F.col("is_error"), "error").otherwise("ok"))
    return F.to_json(F.struct("tool", truncate(F.col("input"), most).alias("input"), note.alias("result")))


def entries(messages: DataFrame, calls: DataFrame, preserve_recent: int = 6) -> DataFrame:
    """One row per message with a text or calls: what it costs in tokens in each form."""
    of = calls.groupBy("session_id", F.col("call_index").alias("message_index")).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("call_seq", _calls(calls, n).alias("c")))), lambda x: x["c"]).alias(name) for name, n in (("c0", INPUTS[0]), ("c1", INPUTS[1]), ("c2", INPUTS[2]), ("c3", None))])
    rows = with_pins(messages, preserve_recent).join(of, ["session_id", "message_index"], "left").filter((F.trim("text") != "") | F.col("c0").isNotNull())

    short = abridge(F.col("text"))
    gone = F.when(F.col("pinned") | (F.col("text") == ""), short).otherwise(F.concat(F.lit("[… "), F.length("text").cast("string"), F.lit(" chars omitted …]")))
    # Tokens don't reach over the quotes between an entry's parts, so each form of a part is counted once; a joint has a comma for two braces.
    tenths = lambda **part: token_tenths(F.to_json(F.struct(*[c.alias(n) for n, c in part.items()])))
    rows = rows.withColumns({"said": F.col("text"), "short": short, "text": gone}).withColumn("t", tenths(i=F.col("message_index"), role=F.col("role")) - 9)
    rows = rows.withColumns({f"t_{n}": tenths(text=F.col(n)) for n in ("said", "short", "text")} | {f"t_{n}": F.when(F.col(n).isNotNull(), tenths(tool_calls=F.col(n)) - 9).otherwise(0) for n in ("c0", "c1", "c2", "c3")})
    cost = lambda text, listed: F.floor((F.col("t") + F.col(f"t_{text}") + F.col(f"t_{listed}") + 9) / 10) + 1
    last = F.when(F.col("pinned"), cost("text", "c2")).otherwise(cost("text", "c3"))
    return rows.select(
        "session_id", "message_index", "role", "pinned", F.col("c0").isNotNull().alias("calls"), "said", "short", "text", "c0", "c1", "c2", "c3",
        cost("said", "c0").alias("k0"), cost("said", "c1").alias("k1"), cost("said", "c2").alias("k2"), cost("short", "c2").alias("k3"), cost("text", "c2").alias("k4"), last.alias("k5"),
        F.when(F.col("pinned") | F.col("c0").isNotNull(), last).otherwise(F.lit(0).cast("long")).alias("k6"),
    )


def fit_state(messages: DataFrame, calls: DataFrame, budget: int, preserve_recent: int = 6, base: int = 50) -> DataFrame:
    """Per session the first stage that fits, its tokens, and how many entries that stage shrank.

    The first three stages apply as a whole; later ones shrink entry by entry,
    the oldest first and pinned ones last, and stop where the running total fits.
    Sessions that no stage fits have the stage 'too large'.  Entries are read
    by two steps and written first, when this is called.
    """
    return fit_entries(table(entries(messages, calls, preserve_recent), "fit-entries"), budget, base)


def fit_entries(rows: DataFrame, budget: int, base: int = 50) -> DataFrame:
    """fit_state(), of what entries() returns."""
    order = Window.partitionBy("session_id").orderBy("pinned", "message_index")
    whole = Window.partitionBy("session_id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = []
    for s in range(3):
        steps.append((s, F.sum(f"k{s}").over(whole) + base, F.lit(0)))
    rank = F.row_number().over(order)
    for s in range(3, 7):
        total = F.sum(f"k{s - 1}").over(whole) + base - F.sum(F.col(f"k{s - 1}") - F.col(f"k{s}")).over(running)
        steps.append((s, total, rank))
    listed = rows.select("session_id", *[F.struct(F.lit(s).alias("stage"), r.cast("int").alias("shrunk"), t.alias("tokens")).alias(f"s{s}") for s, t, r in steps])
    fits = listed.groupBy("session_id").agg(F.least(*[F.min(F.when(F.col(f"s{s}.tokens") <= budget, F.col(f"s{s}"))) for s, _, _ in steps]).alias("first"))
    merged = _folded(rows)
    cost = F.when(F.col("n") == 1, F.col("one")).otherwise(estimate_tokens(F.to_json(F.struct("i", "role", F.lit("").alias("text"), F.col("calls").alias("tool_calls")))) + 1)
    last = merged.groupBy("session_id").agg((F.sum(cost) + base).alias("merged"), F.sum(F.col("n") - 1).cast("int").alias("folded"))
    out = fits.join(last, "session_id", "left")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("first.stage") + 1)
    folded = F.coalesce(F.col("merged") <= budget, F.lit(False))
    return out.select(
        "session_id",
        F.when(F.col("first").isNotNull(), stage).when(folded, F.lit(STAGES[7])).otherwise(F.lit("too large")).alias("stage"),
        F.when(F.col("first").isNotNull(), F.col("first.tokens")).otherwise(F.coalesce("merged", F.lit(0))).cast("long").alias("tokens"),
        F.when(F.col("first").isNotNull(), F.col("first.shrunk")).otherwise(F.coalesce("folded", F.lit(0))).alias("shrunk"),
    )


def _folded(rows: DataFrame) -> DataFrame:
    """Entries of the last stage: neighbouring ones of one role that are calls alone are one. n (how many), one (tokens of a single), i, role, text, calls."""
    foldable = ~F.col("pinned") & (F.col("text") == "")
    kept = rows.filter("pinned or calls").withColumn("fold", foldable)
    by_index = Window.partitionBy("session_id").orderBy("message_index")
    starts = F.when(F.col("fold") & F.coalesce(F.lag("fold").over(by_index), F.lit(False)) & (F.lag("role").over(by_index) == F.col("role")), 0).otherwise(1)
    kept = kept.withColumn("island", F.sum(starts).over(by_index)).withColumn("own", F.when(F.col("pinned"), F.col("c2")).otherwise(F.col("c3")))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "own"))), lambda x: x["own"]))
    return kept.groupBy("session_id", "island").agg(F.count("*").alias("n"), F.min("k6").alias("one"), F.min("message_index").alias("i"), F.min("role").alias("role"), F.min("text").alias("text"), F.when(F.count("own") > 0, listed).alias("calls"))


def fitted_states(messages: DataFrame, calls: DataFrame, budget: int, preserve_recent: int = 6, base: int = 50) -> DataFrame:
    """Per session the state that fits into budget tokens: session_id, stage, tokens, state (JSON: goal, history). Sessions that no stage fits have a null state.

    An entry is rendered once, in the form of its session's stage: of stages
    that shrink entry by entry, entries up to shrunk are in the new form and
    the rest as one stage before.
    """
    rows = table(entries(messages, calls, preserve_recent), "fit-entries")
    stages = table(fit_entries(rows, budget, base), "fit-stages")
    number = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).cast("int") - 1
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pinned", "message_index"))
    own = rows.withColumn("place", place).join(stages.withColumn("s", number), "session_id")
    s = F.when((F.col("s") > 2) & (F.col("place") > F.col("shrunk")), F.col("s") - 1).otherwise(F.col("s"))
    own = own.filter((F.col("s") >= 0) & (F.col("s") < 7)).withColumn("s", s).filter((F.col("s") < 6) | F.col("pinned") | F.col("calls"))
    text = F.when(F.col("s") <= 2, F.col("said")).when(F.col("s") == 3, F.col("short")).otherwise(F.col("text"))
    listed = F.when(F.col("s") == 0, F.col("c0")).when(F.col("s") == 1, F.col("c1")).when((F.col("s") >= 5) & ~F.col("pinned"), F.col("c3")).otherwise(F.col("c2"))
    own = own.select("session_id", F.col("message_index").alias("i"), "role", text.alias("text"), listed.alias("tool_calls"))
    folded = _folded(rows.join(stages.filter(F.col("stage") == STAGES[7]), "session_id", "left_semi")).select("session_id", "i", "role", "text", F.col("calls").alias("tool_calls"))
    entry = lambda df: df.select("session_id", "i", F.to_json(F.struct("i", "role", "text", "tool_calls")).alias("j"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: x["j"])  # of the budget's size at most
    history = entry(own).unionByName(entry(folded)).groupBy("session_id").agg(F.array_join(listed, ",").alias("h"))
    goal = F.to_json(F.struct(F.coalesce("goal", F.lit("")).alias("goal")))
    state = F.concat(F.regexp_replace(goal, r"\}$", ""), F.lit(',"history":['), F.col("h"), F.lit("]}"))
    return stages.join(history, "session_id", "left").join(goal_text(messages), "session_id", "left").select("session_id", "stage", "tokens", state.alias("state"))


def batch_calls(calls: DataFrame, budget: int, overhead: int | str = 0) -> DataFrame:
    """Calls packed in order into requests of at most budget tokens: session_id, call_seq, tokens, batch.

    A question's tokens are those of its input and a line around it; one that
    is too large alone is an error.  overhead (or a column of calls, one value
    a session) is taken off the budget.  A session's calls pass in order, and
    what is held of them is how full the request is.
    """
    spark = ready(calls.sparkSession)
    tokens = estimate_tokens(F.col("input")) + estimate_tokens(F.col("tool")) + 20
    room = budget - (F.lit(overhead) if isinstance(overhead, int) else F.col(overhead))
    rows = calls.select("session_id", F.col("call_seq").cast("int").alias("call_seq"), tokens.alias("tokens"), room.cast("long").alias("room"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id").sortWithinPartitions("session_id", "call_seq")
    schema = pa.schema([("session_id", pa.string()), ("call_seq", pa.int32()), ("tokens", pa.int64()), ("batch", pa.int32())])

    def pack(batches):
        own, used, n = (), 0, 0
        for b in batches:
            numbers = []
            for session, tokens, room in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if tokens > room:
                    raise ValueError("one question is larger than a request")
                if (session,) != own:
                    own, used, n = (session,), 0, 0
                elif used + tokens > room:
                    used, n = 0, n + 1
                used += tokens
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(numbers, pa.int32())], schema=schema)

    return rows.mapInArrow(pack, "session_id string, call_seq int, tokens long, batch int")
