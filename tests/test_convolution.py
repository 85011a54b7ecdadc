"""The convolution net's forward pass against NumPy, its causality, nulls and refusals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import convolution as V

C = ["a", "b", "c", "d"]


def net(spark, seed=0, dilations=(1, 2, 4), hidden=3, outputs=2):
    rows = V.starting_rows(4, hidden, list(dilations), outputs)
    draw = np.random.default_rng(seed)
    return spark.createDataFrame([(*r[:5], float(draw.normal() * 0.5)) for r in rows], V.WEIGHTS)


def plain(x, weights):
    rows = weights.collect()
    last = max(r["layer"] for r in rows)
    for k in range(last + 1):
        own = [r for r in rows if r["layer"] == k]
        n = max(r["output"] for r in own) + 1
        out = np.zeros((len(x), n))
        for r in own:
            if r["input"] < 0:
                out[:, r["output"]] += r["weight"]
                continue
            back = r["tap"] * r["dilation"]
            column = np.concatenate([np.zeros(min(back, len(x))), x[: max(len(x) - back, 0), r["input"]]]) if back else x[:, r["input"]]
            out[:, r["output"]] += r["weight"] * column
        x = np.tanh(out) if k < last else out
    return x


def series(spark, n=30, keys=("u", "v", None)):
    draw = np.random.default_rng(9)
    data = {k: draw.normal(size=(n if k != "v" else 3, 4)) for k in keys}
    rows = [(k, i, *map(float, r)) for k, x in data.items() for i, r in enumerate(x)]
    return data, spark.createDataFrame(rows, "k string, open_time_ms long, a double, b double, c double, d double")


def outputs(df):
    found = {}
    for r in df.orderBy("open_time_ms").collect():
        found.setdefault(r["k"], []).append(r["output"])
    return found


@pytest.mark.parametrize("dilations", [(1, 2), (1, 2, 4), (5,), ()])
def test_equal_to_numpy(spark, dilations):
    data, rows = series(spark)
    weights = net(spark, 1, dilations, 4 if not dilations else 3)
    got = outputs(V.forward(rows, ["k"], C, weights))
    for k, x in data.items():
        assert np.allclose(np.array(got[k]), plain(x, weights), rtol=1e-9, atol=1e-12)


def test_only_the_past_counts_and_nulls_reach_as_far_as_the_net(spark):
    _, rows = series(spark, keys=("u",))
    weights = net(spark, 2, (1, 2))
    before = outputs(V.forward(rows, ["k"], C, weights))["u"]
    changed = outputs(V.forward(rows.withColumn("b", F.when(F.col("open_time_ms") == 10, 99.0).otherwise(F.col("b"))), ["k"], C, weights))["u"]
    missing = outputs(V.forward(rows.withColumn("b", F.when(F.col("open_time_ms") != 10, F.col("b"))), ["k"], C, weights))["u"]
    reached = {10, 11, 12, 13}
    for i in range(30):
        assert (changed[i] != before[i]) == (i in reached)
        assert (missing[i] is None) == (i in reached)


def test_one_shuffle_and_no_python(spark):
    _, rows = series(spark)
    plan = V.forward(rows, ["k"], C, net(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning(k") == 1 and plan.count("Sort [k") == 1


def test_refusals_and_empty_series(spark):
    _, rows = series(spark)
    weights = net(spark)
    assert V.forward(rows.limit(0), ["k"], C, weights).collect() == []
    for bad in (weights.where("NOT (layer = 1 AND input = 0 AND tap = 1 AND output = 0)"), weights.union(weights.limit(1)), weights.limit(0), weights.where("layer <> 1")):
        with pytest.raises(ValueError):
            V.forward(rows, ["k"], C, bad)
