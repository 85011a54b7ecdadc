"""Models by key against NumPy: solves, cells, mixtures and the choice of their components."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits as M


def test_coefficients_of_ten_thousand_keys(spark):
    rows = spark.range(120_000).selectExpr("id % 10000 AS k", "sin(id * 0.7) AS a", "cos(id * id * 0.11) * 3 AS b").withColumns({"y": F.expr("1 + 2 * a - b + k / 1000"), "z": F.expr("a * a")})
    got = M.least_squares(rows, ["k"], ["a", "b"], ["y", "z"])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.k: r for r in got.collect()}
    assert len(found) == 10_000
    for k in (0, 17, 9999):
        assert found[k].y == pytest.approx([1 + k / 1000, 2, -1], abs=1e-5) and found[k].n == 12
        own = np.array([tuple(r) for r in rows.where(F.col("k") == k).select("a", "b", "z").collect()])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2], rcond=None)[0]
        assert found[k].z == pytest.approx(want.tolist(), abs=1e-5)
    fitted = M.predicted(rows.unionByName(spark.createDataFrame([(-1, 1.0, 1.0, 0.0, 0.0)], rows.schema)), got, ["k"], ["a", "b"], "y", "fit")
    worst = fitted.agg(F.max(F.abs(F.col("fit") - F.col("y"))), F.count_if(F.col("fit").isNull())).first()
    assert worst[0] < 1e-4 and worst[1] == 1


def test_elimination_pivots_and_gives_up(spark):
    r = random.Random(2)
    systems = [[[r.gauss(0, 1) for _ in range(4)] + [r.gauss(0, 1), r.gauss(0, 1)] for _ in range(4)] for _ in range(30)]
    for s in systems[:10]:
        s[0][0] = 0.0  # the first pivot must come from elsewhere
    singular = [[1.0, 2.0, 0.0, 0.0, 1.0, 1.0], [2.0, 4.0, 0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 0.0, 1.0, 1.0], [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*systems, singular])], "i int, m array<array<double>>")
    got = {x.i: x.s for x in df.select("i", M.solved(F.col("m"), 4).alias("s")).collect()}
    for i, s in enumerate(systems):
        a = np.array(s)
        assert np.allclose(got[i], np.linalg.solve(a[:, :4], a[:, 4:]), rtol=1e-8, atol=1e-8)
    assert got[30] is None


def test_fit_without_keys_null_keys_and_null_values(spark):
    rows = spark.createDataFrame([(None, float(i), 2.0 * i + 1) for i in range(9)] + [(1, float(i), 5.0) for i in range(4)] + [(1, None, 9.0), (2, 1.0, None)], "k int, a double, y double")
    got = {r.k: (r.n, r.y) for r in M.least_squares(rows, ["k"], ["a"], ["y"]).collect()}
    assert set(got) == {None, 1} and got[None][1] == pytest.approx([1, 2], abs=1e-6) and got[1] == (4, pytest.approx([5, 0], abs=1e-6))
    assert M.predicted(rows.where("k IS NULL"), M.least_squares(rows, ["k"], ["a"], ["y"]), ["k"], ["a"], "y", "fit").where("abs(fit - y) < 1e-6").count() == 9
    whole = M.least_squares(rows.where("k IS NULL"), [], ["a"], ["y"])
    assert whole.first().y == pytest.approx([1, 2], abs=1e-6)


def plain_cells(points, ordered, k, rounds=None):
    c = np.array([ordered[(2 * i + 1) * len(ordered) // (2 * k)] for i in range(k)], float)
    done = 0
    while True:
        at = ((points[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([points[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
        done += 1
        if done == rounds or np.allclose(new, c, rtol=0, atol=1e-13):
            return at
        c = new


def moments(points, at):
    out = []
    for i in sorted(set(at.tolist())):
        own = points[at == i]
        var = np.maximum(own.var(0, ddof=1), 1e-6) if len(own) > 1 else np.full(points.shape[1], 1e-6)
        cov = np.cov(own.T, ddof=1)[0, 1] if points.shape[1] == 2 and len(own) > 1 else 0.0
        limit = 0.999 * math.sqrt(var[0] * var[-1])
        out.append((i, len(own), len(own) / len(points), own.mean(0).tolist(), var.tolist(), min(max(cov, -limit), limit)))
    return out


@pytest.fixture(scope="module")
def clouds():
    r = np.random.default_rng(3)
    out = {}
    for key, n, centres in (("wide", 400, [(0, 0), (4, 1), (1, 5)]), ("long", 300, [(0, 0)]), ("few", 7, [(0, 0), (3, 3)])):
        c = np.array(centres, float)[r.integers(0, len(centres), n)]
        out[key] = c + r.normal(size=(n, 2)) * [1.2, 0.7]
    return out


@pytest.fixture(scope="module")
def cloud_rows(spark, clouds):
    return spark.createDataFrame([(k, i, float(a), float(b)) for k, x in clouds.items() for i, (a, b) in enumerate(x)] + [("wide", 10_000, None, 1.0)], "key string, t int, a double, b double").repartition(5).cache()


@pytest.mark.parametrize("rounds", [None, 1, 3, 30])
@pytest.mark.parametrize("values", [["a"], ["a", "b"]])
def test_mixtures_equal_numpy(cloud_rows, clouds, values, rounds):
    order = ["t"] if len(values) == 2 else ["a"]
    got = M.mixtures(cloud_rows, ["key"], values, order, F.array(F.lit(1), F.lit(2), F.lit(3)), 3, rounds).collect()
    for key, x in clouds.items():
        x = x[:, : len(values)]
        for k in (1, 2, 3):
            want = moments(x, plain_cells(x, x if len(values) == 2 else np.sort(x, 0), k, rounds if k > 1 else 1))
            own = sorted((r for r in got if r.key == key and r.k == k), key=lambda r: r.component)
            assert [(r.component, r.n) for r in own] == [w[:2] for w in want]
            for r, w in zip(own, want):
                assert r.weight == pytest.approx(w[2]) and r["mean"] == pytest.approx(w[3]) and r.variance == pytest.approx(w[4]) and r["cov"] == pytest.approx(w[5], abs=1e-12)


def plain_density(x, parts):
    total = np.zeros(len(x))
    for _, _, weight, mean, var, cov in parts:
        d = x - mean
        if x.shape[1] == 1:
            total += weight * np.exp(-d[:, 0] ** 2 / (2 * var[0])) / math.sqrt(2 * math.pi * var[0])
        else:
            det = var[0] * var[1] - cov**2
            q = (var[1] * d[:, 0] ** 2 - 2 * cov * d[:, 0] * d[:, 1] + var[0] * d[:, 1] ** 2) / det
            total += weight * np.exp(-q / 2) / (2 * math.pi * math.sqrt(det))
    return total


def plain_choice(x, most=3):
    """(losses by k, chosen) for rows in time order."""
    two = x.shape[1] == 2
    if len(x) < (12 if two else 10):
        return {}, 1
    cut = len(x) * 4 // 5
    train, rest = x[:cut], x[cut:]
    found = {}
    for k in range(1, most + 1):
        if k * (5 if two else 3) < cut:
            l = -np.log(np.maximum(1e-15, plain_density(rest, moments(train, plain_cells(train, train if two else np.sort(train, 0), k)))))
            found[k] = (l.mean(), l.std(ddof=1) / math.sqrt(len(l)) if len(l) > 1 else 0.0)
    best = min(found, key=lambda k: (found[k][0], k))
    return found, min(k for k in found if k <= best and found[k][0] <= sum(found[best]))


@pytest.mark.parametrize("values", [["a"], ["a", "b"]])
def test_component_choice_equals_numpy(cloud_rows, clouds, values):
    got = M.component_losses(cloud_rows, ["key"], values, None if len(values) == 1 else "t", "t").collect()
    for key, x in clouds.items():
        losses, chosen = plain_choice(x[:, : len(values)])
        own = {r.k: r for r in got if r.key == key}
        assert [k for k, r in own.items() if r.chosen] == [chosen]
        assert not losses or set(own) == set(losses)
        for k, (loss, se) in losses.items():
            assert (own[k].loss, own[k].se) == (pytest.approx(loss), pytest.approx(se))
    wide = M.mixture(cloud_rows, ["key"], ["a"], ["a"], 2)
    judged = {r.key: r.loss for r in M.losses(cloud_rows, wide, ["key"], ["a"], "t").collect()}
    x = clouds["wide"][:, :1]
    assert judged["wide"] == pytest.approx(-np.log(plain_density(x, moments(x, plain_cells(x, np.sort(x, 0), 2)))).mean())


def test_zero_inflated_equals_numpy(spark):
    r = np.random.default_rng(5)
    up, down = np.exp(r.normal(size=300) * 0.5 + r.integers(0, 2, 300) * 2), np.exp(r.normal(size=300) * 0.4)
    kind = r.choice(["zero", "up", "down", "both"], 300, p=[0.1, 0.2, 0.2, 0.5])
    up[np.isin(kind, ["zero", "down"])], down[np.isin(kind, ["zero", "up"])] = 0, 0
    rows = spark.createDataFrame([("x", i, float(u), float(d)) for i, (u, d) in enumerate(zip(up, down))] + [("x", 999, None, 1.0), ("y", 0, 0.0, 0.0)], "key string, t int, up double, down double")
    got = M.zero_inflated(rows, ["key"], "up", "down", "t").collect()
    assert [(g.kind, g.mass, g.weight) for g in got if g.key == "y"] == [("zero", 1.0, 1.0)]
    for name in ("up", "down", "both"):
        own = sorted((g for g in got if g.key == "x" and g.kind == name), key=lambda g: g.component)
        there = kind == name
        x = np.log(np.column_stack([c[there] for c, n in ((up, "up"), (down, "down")) if name in (n, "both")]))
        k = plain_choice(x)[1]
        want = moments(x, plain_cells(x, x if name == "both" else np.sort(x, 0), k) if k > 1 else np.zeros(len(x), int))
        assert len(own) == len(want)
        for g, (_, _, weight, mean, var, cov) in zip(own, want):
            assert g.mass == pytest.approx(there.mean()) and g.weight == pytest.approx(weight) and g["cov"] == pytest.approx(cov)
            assert (g.mean_up, g.var_up) == ((0.0, 1.0) if name == "down" else (pytest.approx(mean[0]), pytest.approx(var[0])))
            assert (g.mean_down, g.var_down) == ((0.0, 1.0) if name == "up" else (pytest.approx(mean[-1]), pytest.approx(var[-1])))
    total = {}
    for g in got:
        total.setdefault((g.key, g.kind), []).append(g.weight * g.mass)
    assert sum(sum(v) for (key, _), v in total.items() if key == "x") == pytest.approx(1)
