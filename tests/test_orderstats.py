"""Medians of earlier rows against sorted lists, and a series of a million rows."""

from __future__ import annotations

import bisect
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import orderstats
from tidemark.operators.orderstats import prefix_median


@pytest.mark.parametrize("lag", [0, 1, 4])
def test_prefix_medians_equal_sorted_lists(spark, lag, monkeypatch):
    monkeypatch.setattr(orderstats, "LEAST", 1 if lag else 256)
    monkeypatch.setattr(orderstats, "ASKED", 30 if lag else 1 << 16)
    r = random.Random(lag)
    rows = [(k, i * 10, r.choice([None, 1.0, 2.0, r.gauss(0, 1)])) for k, n in (("a", 150), ("b", 1), (None, 40), ("none", 12)) for i in range(n)]
    rows = [(k, i, None if k == "none" else v) for k, i, v in rows]
    got = {(x.k, x.i): (x.v, x.m) for x in prefix_median(spark.createDataFrame(rows, "k string, i long, v double").repartition(5), ["k"], "i", "v", "m", lag).collect()}
    assert len(got) == len(rows)
    for k in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == k]
        for at, (_, i, v) in enumerate(own):
            past = [x for _, _, x in own[: max(0, at - lag + 1)] if x is not None]
            assert got[k, i][0] == v and got[k, i][1] == (pytest.approx(statistics.median(past)) if past else None)


def test_no_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(i, float((i * 7) % 5)) for i in range(30)], "t long, v double")
    got = {x.t: x.m for x in prefix_median(rows, [], "t", "v", "m").collect()}
    assert got == {i: statistics.median([(j * 7) % 5 for j in range(i + 1)]) for i in range(30)}
    assert prefix_median(rows.limit(0), [], "t", "v", "m").count() == 0


def test_a_series_of_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) + F.col("id") / 50).alias("v"))
    began = time.time()
    got = prefix_median(rows, [], "t", "v", "m", 1).where("t % 50021 = 0 OR t = 999999").select("t", "m").collect()
    assert time.time() - began < 300
    seen, want = [], {}
    asked = {x.t for x in got}
    for t, v in rows.orderBy("t").toPandas().itertuples(index=False):
        if t in asked:
            want[t] = statistics.median([seen[(len(seen) - 1) // 2], seen[len(seen) // 2]]) if seen else None
        bisect.insort(seen, v)
    assert {x.t: x.m for x in got} == {t: pytest.approx(m) if m is not None else None for t, m in want.items()}
