"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from gleaner.plans import queries as engine


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = engine.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in engine.ORACLES:
        assert ours
        return
    result = duck.execute(engine.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
