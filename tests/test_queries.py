"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest
from graphs import SF

from lodegraph.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    c = duck.execute(ORACLES[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in c.fetchall()), key=repr)
