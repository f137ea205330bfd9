"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lexiframe.plans import more, registry  # noqa: F401  more adds its queries


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return "" if v is None else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
