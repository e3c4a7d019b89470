"""Every flood-relief query that SQL can state, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidemesh.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def key(row):
    return tuple("\0" if x is None else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
