"""Every query with SQL against DuckDB on the small tables; those without give rows."""

import os

import duckdb
import pytest

from loomstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda x: "null" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    found = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), names)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
