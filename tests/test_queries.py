"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

from tramline.plans import catalogue as queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def text(v):
    return "~" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cursor = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(tuple(text(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) - set(queries.ORACLE) == set()


def test_stream_equals_batch(spark):
    got = {r["type"]: r["n"] for r in queries.QUERIES["events_stream_counts"](spark, DATA).collect()}
    assert got == {r["type"]: r["n"] for r in queries.QUERIES["event_type_counts"](spark, DATA).collect()}
