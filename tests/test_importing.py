"""The import as a stream: stopped, started again, with a batch run twice, an unsteady source and bad rows."""

from __future__ import annotations

import json

import pytest

from tidemark.sources import store
from tidemark.streaming import importing

DAY = 86_400_000


def known(table):
    with open(table) as f:
        return json.load(f)


def unsteady_pages(table, symbol, interval, start_ms, end_ms, limit):
    """Bars of a JSON file; every range fails at its first asking."""
    import os

    mark = f"{table}.{symbol}.{start_ms}"
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("busy")
    return [[t, *x] for t, *x in known(table).get(symbol, []) if start_ms <= t <= end_ms][:limit]


def latest(table, symbol, interval):
    return max((x[0] for x in known(table).get(symbol, [])), default=None)


def bars(n, base=1.0):
    return [[(k + 1) * DAY, base, base + 1, base - 0.5, base + k / 100, k] for k in range(n)]


@pytest.fixture
def run(spark, tmp_path):
    table = tmp_path / "source.json"
    options = {"symbol": "aaa, bbb", "start_ms": str(DAY), "fetch": "tests.test_importing:unsteady_pages", "latest": "tests.test_importing:latest", "limit": "9", "slices": "3", "wait_s": "0.01", "table": str(table)}

    def go(data, path="out", checkpoint="cp"):
        table.write_text(json.dumps(data))
        q = importing.imported(spark, f"file://{tmp_path}/{path}", f"file://{tmp_path}/{checkpoint}", "made", options)
        q.awaitTermination(120)
        assert q.exception() is None
        rows = spark.read.parquet(f"file://{tmp_path}/{path}/bars")
        return {(r.symbol, r.open_time_ms): r.close for r in rows.collect()}, {r.symbol: r for r in importing.series(spark, f"file://{tmp_path}/{path}").collect()}

    return go


def test_import_goes_on_from_its_checkpoint(spark, run, tmp_path):
    run({"AAA": bars(20)})
    run({"AAA": bars(20)})  # nothing new
    full = {"AAA": bars(75), "BBB": bars(40, 5.0)}
    full["AAA"][50][2] = 0.1  # a high below its low
    stopped = run(full)
    once = run(full, "one", "cp-one")
    assert stopped[0] == once[0] and len(once[0]) == 74 + 40
    for found in (stopped[1], once[1]):
        assert {s: (r.first_open_ms, r.last_open_ms, r.refused, r.source) for s, r in found.items()} == {"AAA": (DAY, 75 * DAY, 1, "made"), "BBB": (DAY, 40 * DAY, 0, "made")}


def test_a_batch_run_twice_changes_nothing(spark, run, tmp_path):
    before = run({"AAA": bars(40), "BBB": bars(3)})
    rows = spark.createDataFrame([("AAA", *x[:5], float(x[5])) for x in bars(40)] + [("AAA", 5, 1.0, 0.0, 2.0, 1.0, 1.0)], "symbol string, open_time_ms long, open double, high double, low double, close double, volume double")
    importing.put_batch(f"file://{tmp_path}/out", "made", "1d")(rows, 0)
    again = {(r.symbol, r.open_time_ms): r.close for r in spark.read.parquet(f"file://{tmp_path}/out/bars").collect()}
    series = {r.symbol: r for r in importing.series(spark, f"file://{tmp_path}/out").collect()}
    assert again == before[0] and series == before[1]


def test_a_month_set_aside_is_put_back(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("A", t, c) for t, c in ((DAY, 1.0), (40 * DAY, 2.0))], "symbol string, open_time_ms long, close double")
    store.put_bars(rows, path, ["symbol"])
    (tmp_path / "t" / "month=1970-01").rename(tmp_path / "t" / ".old-x@month=1970-01")
    store.put_bars(rows.where("close = 2").selectExpr("symbol", "open_time_ms", "3D AS close"), path, ["symbol"])
    assert {(r.open_time_ms, r.close) for r in store.stored(spark, path, rows).collect()} == {(DAY, 1.0), (40 * DAY, 3.0)}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc")) == ["month=1970-01", "month=1970-02"]
