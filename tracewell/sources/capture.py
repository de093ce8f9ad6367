"""Sessions of transcripts captured as cases: chosen by size and project, redacted, and written with what their meta says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import redact_messages, secret_counts
from ..storage import table
from .datasets import Cases, counts, decoded, write_case_folders
from .transcripts import LoadOptions, list_sessions, read_transcripts, usage_totals


def session_files(spark: SparkSession, path: str, min_bytes: int = 0, project: str | None = None) -> DataFrame:
    """Files of transcripts under path that are large enough and whose project (their folder) has that in its name: session_id, path, bytes, project; the largest first."""
    rows = list_sessions(spark, path).withColumn("project", F.regexp_extract(decoded(F.col("path")), "([^/]+)/[^/]+$", 1))
    rows = rows.filter(F.col("bytes") >= min_bytes)
    return rows if project is None else rows.filter(F.contains("project", F.lit(project)))


def capture_sessions(spark: SparkSession, path: str, out: str, *, limit: int, min_bytes: int = 0, project: str | None = None, options: LoadOptions | None = None, user_paths: bool = False, captured_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the largest sessions under path, limit at most, as case folders under out, and returns a row for each.

    A case is named project--session.  Its transcript is redacted (secrets, and
    if asked user paths); its meta has counts, totals of usage, the messages
    that are compactions, how many secrets there were, and where it is from.
    Of the result: session_id (the case's name), messages, tool_calls, chars,
    est_tokens, compactions, secrets.
    """
    picked = session_files(spark, path, min_bytes, project).limit(limit).collect()  # limit rows
    own = "session_id string, messages long, tool_calls long, chars long, est_tokens long, compactions int, secrets long"
    if not picked:
        return spark.createDataFrame([], own)
    made = read_transcripts(spark, [r["path"] for r in picked], options)
    # A listing and a scan write a file's URI differently.
    plain = lambda c: F.regexp_replace(decoded(F.col(c)), "^file:/+", "file:/").alias("at")
    about = spark.createDataFrame([(r["path"], r["project"], r["bytes"]) for r in picked], "path string, project string, bytes long")
    places = made.files.select(plain("file"), "file", "session_id").join(about.select(plain("path"), "project", "bytes"), "at")
    names = places.groupBy("session_id").agg(F.min("project").alias("project"), F.min("file").alias("source"), F.sum("bytes").alias("bytes"))
    names = table(names.withColumn("name", F.concat("project", F.lit("--"), "session_id")), "captured-names")
    messages = table(made.messages, "captured-messages")
    options_of = {"user_paths": user_paths}
    hidden = redact_messages(messages, **options_of)
    clean = table(messages.join(hidden.select("session_id").distinct(), "session_id", "left_anti").unionByName(hidden), "captured-redacted")
    rows = counts(clean).join(secret_counts(messages, **options_of), "session_id", "left")
    rows = rows.join(made.compactions.groupBy("session_id").agg(F.sort_array(F.collect_list("message_index")).alias("compactions")), "session_id", "left").join(usage_totals(made.usage), "session_id", "left").join(names, "session_id")
    rows = rows.withColumns({"secrets": F.coalesce("secrets", F.lit(0)), "compactions": F.coalesce("compactions", F.array().cast("array<int>")), "captured_at": F.lit(captured_at)})
    meta = table(rows.select(F.col("name").alias("session_id"), F.to_json(F.struct(*[c for c in rows.columns if c != "name"])).alias("meta"), "messages", "tool_calls", "chars", "est_tokens", F.size("compactions").alias("compactions"), "secrets"), "captured-meta")
    named = clean.join(names.select("session_id", "name"), "session_id").drop("session_id").withColumnRenamed("name", "session_id")
    labels = spark.createDataFrame([], "session_id string, tool_use_id string, label string")
    probes = spark.createDataFrame([], "session_id string, probe_id string, kind string, probe string, place string")
    write_case_folders(Cases(named, labels, probes, meta.select("session_id", "meta")), out)
    return meta.drop("meta")
