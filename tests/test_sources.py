"""Stores, the paged source and the streams."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store
from tidemark.sources.bars import result_blocks
from tidemark.sources.paged import PagedBars
from tidemark.streaming import bars as T

DAY = 86_400_000
BARS = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double"


def rows_of(spark, days, close=1.0):
    return spark.createDataFrame([("A", d * DAY, close, close, close, close, 1.0) for d in days], BARS)


def test_put_bars_replaces_by_key_and_leaves_other_months(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    store.put_bars(rows_of(spark, range(0, 60)), path, ["symbol"])
    store.put_bars(rows_of(spark, range(55, 70), 2.0), path, ["symbol"])
    got = {r.open_time_ms // DAY: r.close for r in spark.read.parquet(path).collect()}
    assert len(got) == 70 and got[54] == 1.0 and got[55] == 2.0 and got[0] == 1.0


def test_versions_are_immutable(spark, tmp_path):
    path = f"file://{tmp_path}/versions"
    store.put_version(rows_of(spark, [3, 1, 2]), path, 1, ["symbol"])
    with pytest.raises(Exception, match="exists"):
        store.put_version(rows_of(spark, [9]), path, 1, ["symbol"])
    live = f"file://{tmp_path}/live"
    store.put_bars(rows_of(spark, [1, 2, 3]), live, ["symbol"])
    a, b = store.bars_of(spark, live, path, 1), store.bars_of(spark, live, path)
    assert a.columns == b.columns and a.collect() == b.collect()


def test_damaged_blocks_fail(spark):
    blocks = result_blocks(rows_of(spark, range(10)), ["symbol"], "open_time_ms", ["close"], 4)
    assert store.block_of(blocks, {"symbol": "A"}, 1).first().n == 4
    with pytest.raises(Exception, match="damaged"):
        store.block_of(blocks.withColumn("body", F.lit("[]")), {"symbol": "A"}, 1).collect()


def test_export_and_restore(spark, tmp_path):
    children = spark.createDataFrame([(1, 10, 5, 5), (2, 20, 1, 1)], "id int, parent int, updated int, created int")
    parents = spark.createDataFrame([(10, "x"), (20, "y")], "parent int, name string")
    store.export_changes(children, parents, F.lit(3), "updated", "created", "parent", "parent", f"file://{tmp_path}/out")
    assert [r.name for r in store.restore(parents.limit(0), f"file://{tmp_path}/out", "parents", ["parent"]).collect()] == ["x"]
    back = store.restore(children.withColumn("updated", F.lit(0)), f"file://{tmp_path}/out", "children", ["id"])
    assert {r.id: r.updated for r in back.collect()} == {1: 5, 2: 0}


def test_manual_prices_win_by_date(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"date": "1970-01-02", "close": 7}\nnonsense\n{"date": "1970-01-09", "close": 8}\n')
    manual = store.read_manual_prices(spark, f"file://{tmp_path}/p.jsonl")
    got = {r.open_time_ms // DAY: r.close for r in store.with_manual_prices(rows_of(spark, [0, 1, 2]).drop("symbol"), manual).collect()}
    assert got == {0: 1.0, 1: 7.0, 2: 1.0, 8: 8.0}


def test_paged_source_reads_every_page_once(spark):
    spark.dataSource.register(PagedBars)
    df = spark.read.format("paged_bars").options(symbol=" abc ", start_ms="0", end_ms=str(99 * DAY), fetch="tidemark.sources.paged:sawtooth", limit="7", slices="3").load()
    got = sorted(r.open_time_ms // DAY for r in df.collect())
    assert got == list(range(100)) and {r.symbol for r in df.collect()} == {"ABC"}


def fed(spark, tmp_path, schema, batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_streamed_bars_close_with_the_watermark(spark, tmp_path):
    at = lambda m: f"2024-01-01T00:{m:02d}:00"
    batches = [
        [{"key": "a", "ts": at(1), "price": 5.0, "id": 1}, {"key": "a", "ts": at(3), "price": 9.0, "id": 2}],
        [{"key": "a", "ts": at(12), "price": 7.0, "id": 3}, {"key": "a", "ts": at(2), "price": 1.0, "id": 4}],
        [{"key": "a", "ts": at(40), "price": 8.0, "id": 5}],
        [{"key": "a", "ts": at(41), "price": 8.0, "id": 7}],  # what is late is judged by the batch before
        [{"key": "a", "ts": at(4), "price": 99.0, "id": 6}],
    ]
    stream = fed(spark, tmp_path, "key string, ts timestamp, price double, id long", batches)
    run(T.resampled(stream, ["key"], "10 minutes", "5 minutes"), tmp_path, "bars")
    got = {r.start.minute: (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars").collect()}
    assert got[0] == (5.0, 9.0, 1.0, 9.0, 3.0) and got[10] == (7.0, 7.0, 7.0, 7.0, 1.0)


def test_streamed_repeats_are_dropped(spark, tmp_path):
    rows = [{"key": "a", "ts": "2024-01-01T00:00:01"}, {"key": "b", "ts": "2024-01-01T00:00:02"}]
    stream = fed(spark, tmp_path, "key string, ts timestamp", [rows, rows])
    run(T.once(stream, ["key"], "1 hour"), tmp_path, "once")
    assert spark.table("once").count() == 2


def test_live_positions_take_each_bar_once(spark, tmp_path):
    bar = lambda t, c, w: {"key": "k", "open_time_ms": t, "close": c, "target": w}
    stream = fed(spark, tmp_path, "key string, open_time_ms long, close double, target double", [[bar(1, 10.0, 1.0), bar(2, 20.0, 0.5)], [bar(2, 20.0, 0.0), bar(3, 10.0, 0.5)]])
    run(T.live_positions(stream), tmp_path, "live")
    got = sorted((r.open_time_ms, r.cash + r.quantity * r.close, r.n) for r in spark.table("live").collect())
    assert got == [(1, 1000.0, 1), (2, 2000.0, 2), (3, 1500.0, 3)]
