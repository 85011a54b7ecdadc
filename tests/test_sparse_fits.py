"""Sparse linear models by key against a plain coordinate descent and the conditions of the optimum."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits


def descent(x, y, l1, l2):
    x0, y0 = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(100_000):
        before = w.copy()
        for j in range(len(w)):
            size = np.mean(x0[:, j] ** 2)
            rest = np.mean(x0[:, j] * (y0 - x0 @ w)) + size * w[j]
            w[j] = np.sign(rest) * max(abs(rest) - l1, 0) / (size + l2) if size + l2 > 1e-14 else 0.0
        if np.all(np.abs(w - before) <= 1e-12 * (1 + np.abs(w))):
            break
    return np.concatenate([[y.mean() - x.mean(0) @ w], w])


def made(seed, n, flat=False):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 4))
    x[:, 1] = 0.9 * x[:, 0] + 0.1 * x[:, 1]  # nearly one direction
    if flat:
        x[:, 3] = 2.0
    return x, 3 + x @ np.array([1.0, -0.5, 0.0, 0.02]) + draw.normal(size=n) * 0.1


def table(spark, parts):
    rows = [(k, *map(float, r), float(t)) for k, (x, y) in parts.items() for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "k string, a double, b double, c double, d double, y double")


X = ["a", "b", "c", "d"]


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.05, 0.0), (0.05, 0.3), (0.0, 0.3)])
def test_equal_to_plain_descent(spark, l1, l2):
    parts = {"u": made(1, 200), "v": made(2, 60, True), None: made(3, 40)}
    got = {r["k"]: np.array(r["y"]) for r in fits.sparse_least_squares(table(spark, parts), ["k"], X, "y", l1, l2).collect()}
    assert set(got) == set(parts)
    for k, (x, y) in parts.items():
        assert np.allclose(got[k], descent(x, y, l1, l2), rtol=1e-6, atol=1e-7)
    if l1:
        assert got["u"][4] == 0 and got["u"][1] != 0  # the small one goes
    assert got["v"][4] == 0


def test_optimum_conditions(spark):
    x, y = made(4, 300)
    w = np.array(fits.sparse_least_squares(table(spark, {"k": (x, y)}), [], X, "y", 0.03).first()["y"])
    slope = np.mean((x - x.mean(0)) * (y - w[0] - x @ w[1:])[:, None], axis=0)
    for j in range(4):
        assert abs(slope[j] - 0.03 * np.sign(w[j + 1])) < 1e-8 if w[j + 1] else abs(slope[j]) <= 0.03 + 1e-9


def test_edges(spark):
    rows = table(spark, {"k": made(5, 30)})
    bad = spark.createDataFrame([("k", 1.0, None, 1.0, 1.0, 9.0), ("k", float("nan"), 1.0, 1.0, 1.0, 9.0), ("k", float("inf"), 1.0, 1.0, 1.0, 9.0), ("none", None, None, None, None, 1.0)], rows.schema)
    plain = fits.sparse_least_squares(rows, ["k"], X, "y", 0.01).first()["y"]
    found = fits.sparse_least_squares(rows.union(bad), ["k"], X, "y", 0.01).collect()
    assert [(r["k"], r["n"]) for r in found] == [("k", 30)] and np.allclose(found[0]["y"], plain)
    assert fits.sparse_least_squares(rows.limit(0), ["k"], X, "y", 0.01).collect() == []
    one = fits.sparse_least_squares(rows.limit(1), ["k"], X, "y", 0.01).first()["y"]
    assert one[1:] == [0.0] * 4 and one[0] == rows.limit(1).first()["y"]
    with pytest.raises(ValueError, match="penalties"):
        fits.sparse_least_squares(rows, ["k"], X, "y", -1.0)


def test_many_keys_are_one_plan(spark):
    rows = spark.range(30_000).select((F.col("id") % 3000).cast("string").alias("k"), *[F.sin(F.col("id") * (i + 1.7)).alias(c) for i, c in enumerate(X)], F.cos(F.col("id") * 0.3).alias("y"))
    assert fits.sparse_least_squares(rows, ["k"], X, "y", 0.01).count() == 3000
