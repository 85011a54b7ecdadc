"""Medoid costs against a plain breadth-first search: components, holes, nulls, repeats and refusals."""

from __future__ import annotations

import random
from collections import deque

import pytest

from tidemark.operators.robust import medoid_costs


def plain(points):
    at, out = set(points), {}
    for s in at:
        far, todo = {s: 0}, deque([s])
        while todo:
            x, y = todo.popleft()
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in at and q not in far:
                    far[q] = far[x, y] + 1
                    todo.append(q)
        out[s] = sum(far.values())
    return out


def costs(spark, points, **more):
    found = medoid_costs(spark.createDataFrame(points, "x int, y int"), ["x", "y"], **more)
    return {(r["x"], r["y"]): r["cost"] for r in found.collect()}


def test_equal_to_a_search(spark):
    draw = random.Random(3)
    points = [(x, y) for x in range(18) for y in range(14) if draw.random() < 0.68]
    got = costs(spark, points + points[:9])
    assert len(points) > 128 and got == plain(points)


def test_a_long_line_a_lone_point_a_null_and_none(spark):
    line = [(i, 0) for i in range(37)]
    got = costs(spark, [*line, (100, 100), (None, 1), (None, None)])
    assert got == plain([*line, (100, 100)]) | {(None, 1): 0, (None, None): 0}
    assert costs(spark, []) == {}


def test_refusals(spark):
    line = [(i, 0) for i in range(10)]
    assert costs(spark, line, most_rounds=9) == plain(line)
    for more in ({"most_rounds": 8}, {"most_rounds": 3}, {"most_points": 9}):
        with pytest.raises(ValueError):
            costs(spark, line, **more)
