"""Every query with SQL against DuckDB over the smallest tables; the others must run and keep their schema."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, float):
        return f"{x:.4g}" if x else "0"
    return str(x)


def same(a, b):
    """Equal cells; numbers to a relative 1e-6 or what rounding leaves."""
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(float(a)) or math.isnan(float(b)):
            return math.isnan(float(a)) and math.isnan(float(b))
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    columns = sorted(columns)
    at = {c[0]: i for i, c in enumerate(found.description)}
    want = sorted(([r[at[c]] for c in columns] for r in found.fetchall()), key=lambda r: [cell(x) for x in r])
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=lambda r: [cell(x) for x in r])
    assert len(got) == len(want)
    assert want, "an empty result proves nothing"
    for g, w in zip(got, want):
        assert all(same(a, b) for a, b in zip(g, w)), (dict(zip(columns, g)), dict(zip(columns, w)))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
