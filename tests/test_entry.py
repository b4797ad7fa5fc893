"""The driver's contract at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from triloom import suite

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in suite.TABLES + ["embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in found)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "seg"] and entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = suite.queries()[name](spark, DATA)
    want = db.execute(suite.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
