"""Cases for evaluation: folders with transcript.json, and beside it labels.json and meta.json where there are any."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_tenths
from ..schema import TOOL_RESULT, TOOL_USE
from ..storage import ready

_MESSAGE = "struct<role: string, text: string, toolUses: array<struct<id: string, tool: string, input: string, text: string, isError: boolean>>, toolResults: array<struct<toolUseId: string, text: string, isError: boolean>>>"
_LABELS = "labels map<string, string>, probes array<struct<id: string, kind: string, text: string, where: string, note: string>>"


@dataclass
class Cases:
    """messages, labels (session_id, tool_use_id, label), probes (session_id, probe_id, kind, probe, place) and meta (session_id, meta: JSON) of all cases; a session is a case's folder, by its path from the root of the cases."""

    messages: DataFrame
    labels: DataFrame
    probes: DataFrame
    meta: DataFrame


def _files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """session_id and value of each file of that name under path; a file of path itself has the name of its folder."""
    files = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(path, wholetext=True)
    folder = F.regexp_replace(decoded(F.col("_metadata.file_path")), "/[^/]+$", "")
    root = re.sub("^[a-z]+:(//[^/]*)?", "", path).rstrip("/")
    inner = F.substr(folder, F.instr(folder, root) + len(root) + 1)
    return files.select(F.when(inner == "", F.substring_index(folder, "/", -1)).otherwise(inner).alias("session_id"), "value")


def decoded(url: Column) -> Column:
    """A file's path as it is on disk."""
    return F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def read_cases(spark: SparkSession, path: str) -> Cases:
    """All cases under path, at any depth. A transcript that can't be read is an error; missing labels and meta have no rows."""
    messages = _files(spark, path, "transcript.json").select("session_id", F.posexplode(F.from_json("value", f"array<{_MESSAGE}>", {"mode": "FAILFAST"})).alias("message_index", "m"))
    uses = F.transform(F.coalesce("m.toolUses", F.array()), lambda u: F.struct(u["id"].alias("tool_use_id"), u["tool"].alias("tool"), u["input"].alias("input"), u["text"].alias("text"), u["isError"].alias("is_error")))
    results = F.transform(F.coalesce("m.toolResults", F.array()), lambda r: F.struct(r["toolUseId"].alias("tool_use_id"), r["text"].alias("text"), r["isError"].alias("is_error")))
    messages = messages.select("session_id", "message_index", "m.role", F.coalesce("m.text", F.lit("")).alias("text"), uses.cast(f"array<{TOOL_USE}>").alias("tool_uses"), results.cast(f"array<{TOOL_RESULT}>").alias("tool_results"))
    given = _files(spark, path, "labels.json").select("session_id", F.from_json("value", _LABELS).alias("g"))
    labels = given.select("session_id", F.explode("g.labels").alias("tool_use_id", "label"))
    probes = given.select("session_id", F.inline("g.probes")).select("session_id", F.col("id").alias("probe_id"), "kind", F.col("text").alias("probe"), F.col("where").alias("place"))
    return Cases(messages, labels, probes, _files(spark, path, "meta.json").withColumnRenamed("value", "meta"))


def counts(messages: DataFrame) -> DataFrame:
    """What a case's meta says of its transcript: messages, tool_calls, chars, est_tokens."""

    def total(of) -> Column:
        return of(F.col("text")) + F.aggregate("tool_uses", F.lit(0).cast("long"), lambda n, u: n + of(u["input"]) + of(F.coalesce(u["text"], F.lit(""))))

    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.size("tool_uses")).alias("tool_calls"), F.sum(total(F.length)).cast("long").alias("chars"), F.floor((F.sum(total(token_tenths)) + 9) / F.lit(10)).cast("long").alias("est_tokens"))


def write_cases(messages: DataFrame, labels: DataFrame, path: str) -> None:
    """Cases as tables under path: messages and labels by session, and the meta that follows from the messages."""
    messages.repartition("session_id").write.mode("overwrite").partitionBy("session_id").parquet(f"{path}/messages")
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    counts(messages).write.mode("overwrite").json(f"{path}/meta")


def write_case_folders(cases: Cases, path: str) -> int:
    """Cases in the form that read_cases() reads: a folder per session under path with transcript.json, labels.json (labels and probes) and meta.json; how many.

    A session's messages pass in order into its file and are never held; a
    task that is run again writes its files over.  meta is given, or counts()
    of the transcript.
    """
    spark = ready(cases.messages.sparkSession)
    uses = F.transform("tool_uses", lambda u: F.struct(u["tool_use_id"].alias("id"), u["tool"].alias("tool"), u["input"].alias("input"), u["text"].alias("text"), u["is_error"].alias("isError")))
    results = F.transform("tool_results", lambda r: F.struct(r["tool_use_id"].alias("toolUseId"), r["text"].alias("text"), r["is_error"].alias("isError")))
    message = F.to_json(F.struct("role", "text", F.when(F.size("tool_uses") > 0, uses).alias("toolUses"), F.when(F.size("tool_results") > 0, results).alias("toolResults")))
    messages = cases.messages.select("session_id", F.lit(2).alias("part"), F.col("message_index").alias("at"), message.alias("j"))
    labels = cases.labels.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("tool_use_id", "label"))).alias("labels"))
    probes = cases.probes.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("probe_id").alias("id"), "kind", F.col("probe").alias("text"), F.col("place").alias("where")))).alias("probes"))
    given = labels.join(probes, "session_id", "full").select("session_id", F.lit(0).alias("part"), F.lit(0).alias("at"), F.to_json(F.struct("labels", "probes")).alias("j"))
    counted = counts(cases.messages)
    meta = counted.join(cases.meta, "session_id", "left").select("session_id", F.lit(1).alias("part"), F.lit(0).alias("at"), F.coalesce("meta", F.to_json(F.struct(*[c for c in counted.columns if c != "session_id"]))).alias("j"))
    rows = given.unionByName(meta).unionByName(messages).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id").sortWithinPartitions("session_id", "part", "at")
    names = ("labels.json", "meta.json", "transcript.json")
    root = path if ":" in path else f"file://{path}"

    def write(batches):
        files, top = pa.fs.FileSystem.from_uri(root)
        out, own, n = None, None, 0
        for b in batches:
            for session, part, _, j in zip(*(c.to_pylist() for c in b.columns)):
                if (session, part) != own:
                    if out is not None:
                        out.write(b"]" if own[1] == 2 else b"")
                        out.close()
                    own = (session, part)
                    n += part == 2
                    files.create_dir(f"{top}/{session}", recursive=True)
                    out = files.open_output_stream(f"{top}/{session}/{names[part]}")
                    out.write(b"[" if part == 2 else b"")
                elif part == 2:
                    out.write(b",\n")
                out.write(j.encode())
        if out is not None:
            out.write(b"]" if own[1] == 2 else b"")
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
