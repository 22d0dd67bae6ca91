"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from grantloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(rows, at):
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(value(r[i]) for i in at) for r in rows], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(registry.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert plain(df.collect(), cols) == plain(got.fetchall(), [names.index(c) for c in cols])
