"""Every query with SQL gives the rows that DuckDB gives."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from strataq.queries import base  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
base.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    try:
        return repr(round(float(value), 9))
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_against_sql(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    cur = duck.execute(base.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL)))
def test_runs(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0
