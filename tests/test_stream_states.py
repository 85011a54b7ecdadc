"""States over a stream: any batching, order within the delay, restart and lateness against the batch operators."""

from __future__ import annotations

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import states as W
from tidemark.streaming.states import kept_states, streamed_states

BARS = "k string, open_time_ms long, close double, p double, ra double, rb double"
MINUTE = 60_000
RATIOS = {"ra": 1.5, "rb": 1.3}


def bars(n=90, keys=("a", "b", None)):
    draw = random.Random(5)
    some = lambda low, high: None if draw.random() < 0.05 else draw.uniform(low, high)
    return [(k, i * MINUTE, 50 * math.exp(draw.gauss(0, 0.02)), some(0.2, 0.8), some(0.5, 1.7), some(0.5, 1.5)) for i in range(1, n + 1) for k in keys]


def put(spark, folder, rows):
    spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, files, delay="5 minutes"):
    return streamed_states(spark.readStream.schema(BARS).option("maxFilesPerTrigger", files).parquet(folder), "k", "p", RATIOS, delay)


def run(spark, tmp_path, files, folder):
    kept_states(stream(spark, folder, files), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "open_time_ms", "direction", "volatility", "state", "occurrence", "start_ms", "trend_deviation", "late", "again").collect()]


def expected(spark, rows, until):
    keys = ["k"]
    at = spark.createDataFrame(rows, BARS).withColumns({"direction": W.direction(F.col("p"), keys), "volatility": W.volatility(RATIOS, keys)})
    at = W.occurrences(at.withColumn("state", F.concat_ws("_", "direction", "volatility")), keys, "state")
    at = W.trend_deviation(at, keys).groupBy().agg(F.collect_list(F.struct("k", "open_time_ms", "direction", "volatility", "state", "occurrence", "trend_deviation")).alias("l"))
    return {(r["k"], r["open_time_ms"]): r for r in at.first()["l"] if r["open_time_ms"] < until}


def compare(got, want):
    assert sorted((r[:2] for r in got), key=str) == sorted(want, key=str)
    starts = {}
    for k, t, direction, volatility, state, occurrence, start, deviation, *_ in sorted(got, key=lambda r: r[1]):
        w = want[k, t]
        assert (direction, volatility, state, occurrence) == (w["direction"], w["volatility"], w["state"], w["occurrence"])
        assert start == starts.setdefault((k, occurrence), t)
        assert (deviation is None) == (w["trend_deviation"] is None)
        assert deviation is None or math.isclose(deviation, w["trend_deviation"], rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize(("parts", "files"), [(1, 1), (6, 1), (9, 4)])
def test_any_batching_gives_the_batch_result(spark, tmp_path, parts, files):
    rows = bars()
    # within the delay rows come in any order
    mixed = sorted(rows, key=lambda r: r[1] + (zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 4) * MINUTE)
    each = math.ceil(len(mixed) / parts)
    for i in range(parts):
        put(spark, f"{tmp_path}/in", mixed[i * each : (i + 1) * each])
    got = run(spark, tmp_path, files, f"{tmp_path}/in")
    compare(got, expected(spark, rows, 85 * MINUTE))
    assert all(r[-2:] == (0, 0) for r in got)


def test_restart_goes_on_and_late_rows_are_counted(spark, tmp_path):
    rows = bars()
    first, second = [r for r in rows if r[1] <= 40 * MINUTE], [r for r in rows if r[1] > 40 * MINUTE]
    again = [(k, t, c / 2, 0.0, 9.0, 9.0) for k, t, c, *_ in first if t == 38 * MINUTE and k == "a"]
    put(spark, f"{tmp_path}/in", first + again)
    assert len(run(spark, tmp_path, 1, f"{tmp_path}/in")) == 3 * 34
    late = [("a", 10 * MINUTE, 1.0, 0.9, 9.0, 9.0), ("a", 20 * MINUTE, 1.0, 0.9, 9.0, 9.0), ("b", 34 * MINUTE, 1.0, 0.9, 9.0, 9.0)]
    no_bars = [("a", None, 1.0, 0.9, 9.0, 9.0), ("b", 60 * MINUTE, 0.0, 0.9, 9.0, 9.0), ("b", 61 * MINUTE, None, 0.9, 9.0, 9.0)]
    put(spark, f"{tmp_path}/in", second + late + no_bars)
    got = run(spark, tmp_path, 1, f"{tmp_path}/in")
    compare(got, expected(spark, rows, 85 * MINUTE))
    last = {r[0]: r[-2:] for r in sorted(got, key=lambda r: r[1])}
    assert last == {"a": (2, 1), "b": (1, 0), None: (0, 0)}


def test_empty_stream(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [])
    kept_states(stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
