from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1:2].isdigit())]


def plain(frame):
    def one(value):
        if value is None or value != value or str(value) in ("<NA>", "NaT"):
            return "null"
        return f"{value:.5f}" if isinstance(value, float) else str(value)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if name not in entry.oracle_sql():
        return
    with duckdb.connect() as connection:
        connection.execute("set timezone = 'UTC'")
        for file in os.listdir(DATA):
            connection.execute(f"create view {file[:-8]} as select * from '{DATA}/{file}'")
        want = connection.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for frame in (got, want):
        for column in frame.columns:
            if frame[column].dtype.kind == "f" and column.endswith("gold_rank"):
                frame[column] = frame[column].astype("Int64")
    assert plain(got) == plain(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
