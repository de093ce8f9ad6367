"""Every query against its SQL on the smallest tables, where they are."""

import numbers
import os

import pytest

import __spark_entry__
from tracewell import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return connection


def rows(frame, columns):
    def plain(v):
        return "null" if v is None or str(v) in ("nan", "<NA>", "NaT", "None") else f"{float(v):.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).fetchdf()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
