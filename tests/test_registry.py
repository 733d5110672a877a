"""Every registered query of the library's own operators, against its SQL in DuckDB."""

import math

import duckdb
import pytest

from wayfowl.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    sql = registry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want
