"""State by session that later compactions go by: the last one, and whether the session is trusted.

Values are upserted with a version and never rewritten: the newest version wins
when they are read, and the others go when batches are merged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .committed import Committed

STATE = "session_id string, name string, value string, version long"
LAST, TRUSTED = "last_compaction", "trusted"


def newest(rows: DataFrame) -> DataFrame:
    """One row for each session and name: that of the greatest version (then value); a null value says that it is gone, and has no row."""
    best = rows.groupBy("session_id", "name").agg(F.max(F.struct("version", F.col("value").isNotNull().alias("there"), "value")).alias("v"))
    return best.filter("v.there").select("session_id", "name", "v.value", "v.version")


class StateTable:
    """Named values by session under a folder. Any number of writers may upsert; merge() by one at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.store = Committed(spark, path, buckets)

    def upsert(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds session_id, name, value, version; under a batch's name only once."""
        name = batch or f"put-{uuid.uuid4().hex}"
        if not self.store.has(name):
            best = rows.groupBy("session_id", "name").agg(F.max(F.struct("version", F.col("value").isNotNull().alias("there"), "value")).alias("v"))
            self.store.commit(name, {"state": (best.select("session_id", "name", "v.value", F.col("v.version").cast("long").alias("version")), ["session_id", "name"])})

    def read(self, session_id: str | None = None) -> DataFrame:
        rows = self.store.rows("state", STATE)
        if session_id is not None:
            rows = rows.filter((F.col("bucket") == self.store.bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
        return newest(rows)

    def merge(self) -> None:
        """Writes the newest versions as one batch in the place of all; values that are gone leave no trace."""
        self.store.commit(f"merge-{uuid.uuid4().hex}", {"state": (self.read(), ["session_id", "name"])}, self.store.all_of("state"))

    def last_compactions(self) -> DataFrame:
        """session_id, compaction (JSON), version."""
        return self.read().filter(F.col("name") == LAST).select("session_id", F.col("value").alias("compaction"), "version")

    def trusted(self) -> DataFrame:
        return self.read().filter((F.col("name") == TRUSTED) & (F.col("value") == "true")).select("session_id")


def compaction_state(report: DataFrame, compaction_id: str, version: int) -> DataFrame:
    """What upsert() takes after a compaction: its id, tokens before and after and whether it was accepted, for each session of its report."""
    value = F.to_json(F.struct(F.lit(compaction_id).alias("compaction_id"), "tokens_before", "tokens_after", "accepted"))
    return report.select("session_id", F.lit(LAST).alias("name"), value.alias("value"), F.lit(version).cast("long").alias("version"))
