"""Streams into the archive and out of it: records put once each, and what prompts bring back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import RehydrateOptions
from ..operators.archive import Archive
from ..operators.retrieve import rehydrate


def archive_stream(records: DataFrame, archive: Archive, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts putting a stream of records into the archive, each micro-batch under the stream's name and its number.

    A micro-batch that is run again after a failure adds nothing if its commit
    was made, and is written over if it wasn't.  A record that comes with
    other content stops the stream.  A name must not be used with another
    checkpoint.
    """
    return records.writeStream.foreachBatch(lambda df, n: archive.put(df, f"{name}-{n:012d}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retrieval_stream(prompts: DataFrame, records: Callable[[], DataFrame], out: str, checkpoint: str, options: RehydrateOptions | None = None, **trigger) -> StreamingQuery:
    """Starts answering a stream of prompts (query_id, session_id, text) with what their own session's archive brings back.

    records is asked for the archive at each micro-batch, so prompts see what
    was archived by then.  Answers go to out, a folder per micro-batch that
    is written over if it is run again.
    """

    def answer(df: DataFrame, n: int) -> None:
        rehydrate(df, records(), options).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return prompts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
