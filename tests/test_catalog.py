"""Every registered query of the engine against its SQL on DuckDB."""

import duckdb
import pytest

from tickframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    at = [columns.index(c) for c in got.columns]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) > 0
    assert sorted(got, key=repr) == sorted(want, key=repr)
