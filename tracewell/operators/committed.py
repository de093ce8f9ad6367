"""Tables in batches with commit records, in hashed buckets.

A batch counts once its commit record is there, which is put in place in one
step: readers see all of it or nothing, and a batch that is written again adds
nothing.  A commit can replace buckets of earlier batches.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_path, write_once


class Committed:
    """Tables under one folder whose batches are committed together; readers at any time, several writers as long as none of them replaces buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets is what a new folder is laid out in; one that is there keeps its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = next((c["buckets"] for c in self.commits()), buckets)

    def commits(self) -> list:
        """All commit records, a row for each batch."""
        try:
            rows = self.spark.read.schema("batch string, buckets int, replaces string").option("pathGlobFilter", "*.json").json(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda r: r["batch"])

    def has(self, batch: str) -> bool:
        return any(c["batch"] == batch for c in self.commits())

    def rows(self, what: str, columns: str) -> DataFrame:
        """Rows of all batches that count, without buckets that were replaced; with batch and bucket."""
        commits = self.commits()
        gone: dict[str, set[int]] = {}
        for c in commits:
            for batch, buckets in json.loads(c["replaces"]).get(what, {}).items():
                gone.setdefault(batch, set()).update(buckets)
        columns += ", batch string, bucket int"
        there = [c["batch"] for c in commits if len(gone.get(c["batch"], ())) < self.buckets and self._exists(f"{self.path}/{what}/batch={c['batch']}")]
        if not there:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(columns).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/batch={b}" for b in there])
        for b in there:
            if b in gone:
                rows = rows.filter((F.col("batch") != b) | ~F.col("bucket").isin(*sorted(gone[b])))
        return rows

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commit(self, batch: str, tables: dict[str, tuple[DataFrame, list[str]]], replaces: dict | None = None) -> None:
        """Writes tables (rows and their order; buckets go by its first column) as a batch, over what an earlier attempt left, then its record."""
        for what, (rows, order) in tables.items():
            order = ["bucket", *order]
            dealt = rows.withColumn("bucket", self.bucket(F.col(order[1]))).repartitionByRange(*order).sortWithinPartitions(*order)
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{what}/batch={batch}")
        write_once(self.spark, f"{self.path}/commits/{batch}.json", json.dumps({"batch": batch, "buckets": self.buckets, "replaces": json.dumps(replaces or {})}))

    def all_of(self, *whats: str) -> dict:
        """What a commit replaces that takes the place of everything."""
        return {what: {c["batch"]: list(range(self.buckets)) for c in self.commits()} for what in whats}

    def vacuum(self) -> None:
        """Removes the files of buckets that were replaced; readers that began before may still need them."""
        for c in self.commits():
            for what, batches in json.loads(c["replaces"]).items():
                for batch, buckets in batches.items():
                    whole = f"{self.path}/{what}/batch={batch}"
                    for path in [whole] if len(buckets) == self.buckets else [f"{whole}/bucket={n}" for n in buckets]:
                        drop_path(self.spark, path)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
