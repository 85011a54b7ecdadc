"""Bounds refuse; they never shorten a result in silence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import sampling as G

GRID = {"a": (0, 99), "b": (0, 99)}


def test_all_points_of_a_narrow_law_are_found(spark):
    legal = F.col("a") < 10
    got = G.discrete_sample(spark, GRID, 990, 3, legal=legal)
    rows = [tuple(r)[1:] for r in got.collect()]
    assert len(set(rows)) == len(rows) == 990 and all(a < 10 for a, _ in rows)
    plan = G.global_plan(spark, GRID, {"a": 0, "b": 0}, 900, legal=legal)
    assert plan.where("origin = 'sobol'").select("a", "b").distinct().count() == 900
    small = {"a": (0, 6), "b": (0, 12)}
    assert G.halton_sample(spark, small, 91).select("a", "b").distinct().count() == 91


def test_more_points_than_there_are_is_refused(spark):
    legal = F.col("a") < 10
    taken = spark.createDataFrame([(0, b) for b in range(100)], "a int, b int")
    for make in (
        lambda: G.discrete_sample(spark, GRID, 1001, 3, legal=legal),
        lambda: G.discrete_sample(spark, GRID, 901, 3, excluded=taken, legal=legal),
        lambda: G.global_plan(spark, GRID, {"a": 0, "b": 0}, 1001, legal=legal),
        lambda: G.halton_sample(spark, GRID, 9901, excluded=taken),
    ):
        with pytest.raises(ValueError):
            make()
    assert G.discrete_sample(spark, GRID, 900, 3, excluded=taken, legal=legal).count() == 900


def test_search_that_cannot_be_counted_ends_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(G, "COUNTED", 10)
    monkeypatch.setattr(G, "MOST_TRIES", 4000)
    with pytest.raises(ValueError, match="of 20 points"):
        G._found(lambda n: G._first_of_each(spark.range(n).selectExpr("id AS attempt", "id % 7 AS a"), ["a"], "attempt"), 20, 4000)


def test_missing_keys(spark):
    rows = [(c, k) for c in range(40) for k in range(60) if (c * k) % 7]
    rows += [(None, 5), (3, None)]
    got = {tuple(r) for r in J.missing_by_configuration(spark.createDataFrame(rows, "c int, k int"), "c", "k").select("c", "k").collect()}
    there = {r for r in rows if r[0] is not None}
    assert got == {(c, k) for c in {c for c, _ in there} for k in {k for _, k in there}} - there
    with pytest.raises(ValueError, match="configurations"):
        J.missing_by_configuration(spark.range(50).selectExpr("id AS c", "1 AS k"), "c", "k", most=49)
    plan = J.missing_by_configuration(spark.createDataFrame(rows, "c int, k int"), "c", "k")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
