"""Every query with an SQL twin gives the same rows on both engines."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomlog.fixtures import FIXTURES, TABLES, duckdb_sql, fixture

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _duck_rows(con, sql, cols):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


def _spark_rows(df, cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", list(FIXTURES))
def test_fixture(spark, duck, sf_dir, name):
    df = fixture(spark, sf_dir, name)
    cols = sorted(df.columns)
    assert _spark_rows(df, cols) == _duck_rows(duck, duckdb_sql(f"SELECT * FROM {{{name}}}"), cols)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = _spark_rows(df, cols)
    if name in ORACLES:
        assert mine == _duck_rows(duck, ORACLES[name], cols)
    else:
        assert mine


def test_entry(spark):
    assert entry.entry(spark).columns == ["session_id", "store", "scope", "title", "text"]
