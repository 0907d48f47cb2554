"""Every registered query of the engine against its SQL on the smallest tables."""

import importlib
import math
import os

import duckdb
import pytest

from quarry import catalog

PAIRS = [(m, n) for m in catalog.MODULES for n in importlib.import_module(f"quarry.plans.{m}").QUERIES]


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize(("module", "name"), PAIRS)
def test_query(spark, data, duck, module, name):
    f, sql = importlib.import_module(f"quarry.plans.{module}").QUERIES[name]
    df = f(spark, data)
    rows = df.collect()
    assert rows
    if sql:
        x = duck.execute(sql)
        names = [c[0] for c in x.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in x.fetchall())
        got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in rows)
        assert got == want
