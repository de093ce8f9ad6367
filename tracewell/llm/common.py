"""What the operators share: shipping code, shared folders, Arrow helpers."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, table

ROOT = str(Path(__file__).resolve().parents[2])

#: Words of every contract: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ready(df: DataFrame) -> SparkSession:
    """The session of df; Python workers started from now on can import this package."""
    spark = df.sparkSession
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


#: Rows from which a key counts as hot, and hot keys at most: the bar rises with the rows, so that no more keys can reach it.
HOT_ROWS, HOT_KEYS = 2_000, 100_000


def join_by_size(left: DataFrame, left_key: str, right: DataFrame, right_key: str, size: str, total: int) -> DataFrame:
    """The inner join of left with right, whose keys are unique; size is a column of right, how many rows of left have its key, and total no less than left's rows.

    Rows of hot keys stay where they are and meet a broadcast: at most
    HOT_KEYS keys can be hot.  All others are joined by a shuffle in which
    no key has more rows than the bar.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot, cool = right.filter(F.col(size) > bar), right.filter(F.col(size) <= bar)
    same = F.col(left_key) == F.col(right_key)
    if hot.isEmpty():
        return left.join(cool, same)
    rest = left.join(F.broadcast(hot.select(right_key)), same, "left_anti").join(cool, same)
    return left.join(F.broadcast(hot), same).unionByName(rest)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id_col and text: a null text is empty."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return dict(df.dtypes)[id_col]


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; the id null counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(df: DataFrame, id_col: str, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    """An Arrow schema of the id column with its own type, then fields."""
    from pyspark.sql.pandas.types import to_arrow_type

    if id_col in dict(fields):
        raise ValueError(f"the id column can't be called {id_col}: the result has a column of that name")
    return pa.schema([(id_col, to_arrow_type(df.schema[id_col].dataType)), *fields])


def map_texts(df: DataFrame, id_col: str, text_col: str, fields, make) -> DataFrame:
    """Runs make() once per task for a function of a list of texts to one list per field; the ids stay in Arrow.

    Slices of a batch are bounded by characters, so that very long texts don't gather in one call.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    ready(df)
    schema = arrow_schema(df, id_col, *fields)

    def run(batches):
        work = make()
        for b in batches:
            for ids, part in slices(b):
                yield batch(schema, ids, *work(part))

    return texts(df, id_col, text_col).mapInArrow(run, from_arrow_schema(schema))


def numbered(df: DataFrame) -> DataFrame:
    """df with a column _row that tells all rows apart, those that repeat others too, written so that it stays as it is."""
    return table(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def keep_rows(df: DataFrame, id_col: str, text_col: str, decided: DataFrame) -> DataFrame:
    """One row of df for each id and hash of the text (_id, _print) that decided marks as kept, with df's own columns.

    Rows that repeat id and text are told apart by a number each; the first
    stays.  Only these numbers are grouped, not the rows.
    """
    left = numbered(df.select(F.struct(*[df[c] for c in df.columns]).alias("_own"), F.col(id_col).alias("_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_p")))
    firsts = left.groupBy("_i", "_p").agg(F.min("_row").alias("_first"))
    right = decided.filter("kept").select("_id", "_print").distinct()
    kept = firsts.join(right, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_p") == F.col("_print")), "left_semi").select("_first")
    return left.join(kept, F.col("_row") == F.col("_first"), "left_semi").select("_own.*")


def slices(b: pa.RecordBatch, most: int = 8_000_000):
    """(ids, texts) of a batch of two columns, in slices of about most bytes of text at most."""
    import numpy as np
    import pyarrow.compute as pc

    ids, column = b.column(0), b.column(1)
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield ids.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
        start = stop
