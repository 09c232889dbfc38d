"""Every registered query of the library against the other engine's SQL on the smallest tables."""

import math

import duckdb
import pytest

from pagewright import catalog

SF = "/root/testdata/sf0.001"
#: Empty on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in catalog.BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SAID))
def test_equals_the_other_engine(spark, other, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = other.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SAID)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and df.columns
    assert not any(None in (r[0],) for r in rows)
