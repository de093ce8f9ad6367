"""Times the headline queries: one JSON line on standard output. The rows are written to the noop sink, so every column is computed."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINE = ("session_tokens", "ledger_events", "tool_calls", "dependency_edges", "ruleset_scores", "decide_actions", "compaction_report", "archive_stats", "search_topk", "redact_credentials", "fit_stage", "auto_trigger")


def main() -> None:
    from pyspark.sql import SparkSession

    from tracewell.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["session_tokens"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's threads
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    sessions = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "sessions": sessions, "sessions_per_sec_decided": round(sessions / times["decide_actions"], 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
