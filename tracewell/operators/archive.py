"""The archive: append-only Parquet tables of records and of their ids, with lookups, lists and totals.

A record is known by its session and id: ids are hashes of content, so two
sessions may well have the same.

Records are dealt to buckets by a hash of their session, an index of
(id, session, content hash) by a hash of the id; both are sorted within their
buckets, so a lookup reads one bucket of one of them.  Both are committed together,
batch by batch; records are purged, and small batches merged, by batches that
replace buckets of earlier ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import SPACE, truncate
from ..schema import ARCHIVE
from ..storage import table
from .committed import Committed

KEY = ["session_id", "id"]
IDS = "id string, session_id string, content_hash string"
#: Keys up to which a batch's are broadcast to what is known; more meet it in a shuffle.
BROADCAST_KEYS = 100_000


def fresh_records(known: DataFrame, records: DataFrame) -> DataFrame:
    """One of each session and id among records, without those that known has.

    An id that comes with other content than in known, or with two contents
    among records, is an error.  Of known only the keys of records are grouped;
    where nothing is known, as in a first batch, records aren't read for their keys.
    """
    once = records.groupBy(*KEY).agg(F.min(F.struct("content_hash", *[c for c in records.columns if c not in (*KEY, "content_hash")])).alias("r"), F.max("content_hash").alias("other"))
    if known.isEmpty():
        joined = once.withColumn("had", F.lit(None).cast("string"))
    else:
        keys = records.select(*KEY).distinct()
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        had = known.join(F.broadcast(keys) if few else keys, KEY, "left_semi").groupBy(*KEY).agg(F.min("content_hash").alias("had"))
        joined = once.join(had, KEY, "left")
    clash = F.raise_error(F.concat(F.lit("archive record "), F.col("id"), F.lit(" of session "), F.col("session_id"), F.lit(" exists with different content")))
    same = (F.col("r.content_hash") == F.col("other")) & F.coalesce(F.col("had") == F.col("other"), F.lit(True))
    checked = joined.withColumn("fresh", F.when(same, F.col("had").isNull()).otherwise(clash.cast("boolean")))
    return checked.filter("fresh").select(*[F.col(c) if c in KEY else F.col(f"r.{c}").alias(c) for c in records.columns])


def summaries(records: DataFrame) -> DataFrame:
    """Records without their content: a preview of 120 characters instead."""
    preview = truncate(F.trim(F.regexp_replace("content", SPACE + "+", " ")), 120)
    return records.withColumn("preview", preview).drop("content", "metadata")


def matching(records: DataFrame, session_id: str | None = None, kinds: list[str] | None = None, tools: list[str] | None = None) -> DataFrame:
    if session_id is not None:
        records = records.filter(F.col("session_id") == session_id)
    if kinds is not None:
        records = records.filter(F.col("kind").isin(*kinds))
    return records if tools is None else records.filter(F.col("tool_name").isin(*tools))


def newest(records: DataFrame, n: int) -> DataFrame:
    """The last n by seq, oldest first."""
    return records.orderBy(F.col("seq").desc(), F.col("id").desc()).limit(n).orderBy("seq", "id")


def totals(records: DataFrame) -> DataFrame:
    """Records and tokens of each session, and of all (session_id null)."""
    return records.rollup("session_id").agg(F.count("*").alias("records"), F.sum("token_estimate").alias("tokens"), F.grouping("session_id").cast("int").alias("overall"))


def get_many(records: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Records of (session_id, id) in the order asked for; keys that aren't there have no row."""
    wanted = records.sparkSession.createDataFrame([(n, *k) for n, k in enumerate(keys)], "place int, session_id string, id string")
    return records.join(F.broadcast(wanted) if len(keys) <= BROADCAST_KEYS else wanted, KEY).orderBy("place").drop("place")


def why(records: DataFrame) -> DataFrame:
    """A row for each reason why a record left: session_id, id, kind, tool_name, action, place, code, detail, related."""
    related = F.array_join(F.transform("related", lambda r: F.concat(r["relation"], F.lit(" "), r["id"])), ", ")
    return records.select(*KEY, "kind", "tool_name", "action", F.posexplode_outer("reasons").alias("place", "r"), related.alias("related")).select(*KEY, "kind", "tool_name", "action", "place", "r.code", "r.detail", "related")


def restored(records: DataFrame) -> DataFrame:
    """Records with block: the whole content in a wrapper that says where it is from."""
    return records.withColumn("block", wrapped("restored_context", F.col("content")))


def wrapped(tag: str, content: Column) -> Column:
    """content between tags that carry a record's id, kind, tool and seq; what is null or empty has no attribute."""
    value = lambda c: F.regexp_replace(F.col(c).cast("string"), '["<>]', "")
    named = [F.when(F.coalesce(value(c), F.lit("")) != "", F.concat(F.lit(f' {name}="'), value(c), F.lit('"'))) for name, c in (("id", "id"), ("kind", "kind"), ("tool", "tool_name"), ("seq", "seq"))]
    return F.concat(F.lit(f"<{tag}"), F.concat_ws("", *named), F.lit(">\n"), F.coalesce(content, F.lit("")), F.lit(f"\n</{tag}>"))


class Archive:
    """An archive under a folder. One writer at a time; readers at any time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.store = spark, Committed(spark, path, buckets)

    @property
    def buckets(self) -> int:
        return self.store.buckets

    def _of_session(self, session_id: str | None) -> DataFrame:
        rows = self.store.rows("data", ARCHIVE)
        return (rows if session_id is None else rows.filter(F.col("bucket") == self.store.bucket(F.lit(session_id)))).drop("batch", "bucket")

    def read(self) -> DataFrame:
        return self._of_session(None)

    def ids(self) -> DataFrame:
        """id, session_id, content_hash of all records."""
        return self.store.rows("ids", IDS).drop("batch", "bucket")

    def put(self, records: DataFrame, batch: str | None = None) -> None:
        """Adds what is new; the same record again changes nothing, other content under a known id of its session fails.

        A batch of a name that counts already adds nothing, so what was cut
        short can be put again under its name.
        """
        name = batch or f"put-{uuid.uuid4().hex}"
        if not self.store.has(name):
            self._commit(name, table(fresh_records(self.ids(), records), "archive-fresh"))

    def _commit(self, name: str, rows: DataFrame, replaces: dict | None = None, ids: DataFrame | None = None) -> None:
        rows = rows.select(*StructType.fromDDL(ARCHIVE).names)
        ids = rows.select("id", "session_id", "content_hash") if ids is None else ids
        self.store.commit(name, {"data": (rows, ["session_id", "id"]), "ids": (ids, ["id", "session_id"])}, replaces)

    def get(self, session_id: str, id: str) -> DataFrame:
        return self._of_session(session_id).filter((F.col("session_id") == session_id) & (F.col("id") == id))

    def locate(self, id: str) -> DataFrame:
        """The sessions that have a record of that id, from one bucket of the index."""
        rows = self.store.rows("ids", IDS)
        return rows.filter((F.col("bucket") == self.store.bucket(F.lit(id))) & (F.col("id") == id)).select("session_id").distinct()

    def why(self, session_id: str, id: str) -> DataFrame:
        return why(self.get(session_id, id))

    def get_many(self, keys: list[tuple[str, str]]) -> DataFrame:
        """get_many(), from the buckets of the keys' sessions."""
        rows, sessions = self.store.rows("data", ARCHIVE), sorted({s for s, _ in keys})
        if len(sessions) <= 4 * self.store.buckets:
            rows = rows.filter(F.col("bucket").isin(*[self.store.bucket(F.lit(s)) for s in sessions]))
        return get_many(rows.drop("batch", "bucket"), keys)

    def restore(self, keys: list[tuple[str, str]]) -> DataFrame:
        """The blocks that put records back, in the order asked for."""
        return restored(self.get_many(keys))

    def list(self, limit: int | None = None, **where) -> DataFrame:
        rows = summaries(matching(self._of_session(where.get("session_id")), **where)).orderBy("seq", "archived_at", "id")
        return rows if limit is None else rows.limit(limit)

    def stats(self, session_id: str | None = None) -> DataFrame:
        return totals(matching(self._of_session(session_id), session_id))

    def sessions(self) -> DataFrame:
        return self.ids().select("session_id").distinct()

    def purge(self, keys: DataFrame) -> int:
        """Removes the records of keys (session_id, id); how many went.

        The buckets that have any are written anew without them, as a batch
        whose commit replaces the old ones: until it is there nothing is
        gone, then all of it is.
        """
        keys = table(keys.select(*KEY).distinct(), "archive-keys")
        made, replaces = {}, {}
        for what, columns in (("data", ARCHIVE), ("ids", IDS)):
            rows = self.store.rows(what, columns)
            touched = rows.join(keys, KEY, "left_semi").groupBy("batch", "bucket").count().collect()  # a row for each batch and bucket
            n = sum(r["count"] for r in touched)
            if not n:
                return 0
            replaces[what] = {b: sorted(r["bucket"] for r in touched if r["batch"] == b) for b in {r["batch"] for r in touched}}
            old = self.spark.createDataFrame([(r["batch"], r["bucket"]) for r in touched], "batch string, bucket int")
            made[what] = rows.join(F.broadcast(old), ["batch", "bucket"], "left_semi").join(keys, KEY, "left_anti").drop("batch", "bucket")
        self._commit(f"purge-{uuid.uuid4().hex}", made["data"], replaces, made["ids"])
        return n

    def merge(self) -> None:
        """Writes all batches as one, as after many small ones of a stream. Replays of the merged batches still add nothing."""
        if self.store.commits():
            self._commit(f"merge-{uuid.uuid4().hex}", self.read(), self.store.all_of("data", "ids"))

    def vacuum(self) -> None:
        self.store.vacuum()
