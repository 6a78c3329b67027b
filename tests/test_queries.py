"""Every registered search query against its SQL, where the tables are there."""

import os

import duckdb
import pytest

from corpusgrep.operators import harness
from corpusgrep.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    df, want = catalogue.queries()[name](spark, DATA), con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a, b, c\n1, "x, \\"y\\"", 007\n2, , z\n')
    assert [tuple(r) for r in harness.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'x, "y"', "007"), ("2", None, "z")]
