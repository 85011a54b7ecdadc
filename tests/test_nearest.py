"""The nearest vector of a cell against all pairs, with copies, equal ids, odd vectors and cells of several blocks; the work is by blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.operators import joins as J


def plain(rows):
    """{id: nearest} of (id, cell, vector) by all pairs; None without a distance, NaN last."""
    out = {}
    for i, c, v in rows:
        for j, k, w in rows:
            if i is None or j is None or i == j or c is None or c != k:
                continue
            d = None
            if v is not None and w is not None and len(v) == len(w) and None not in v and None not in w:
                d = math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, w)))
            old = out.get(i)
            out[i] = d if old is None else old if d is None or math.isnan(d) else d if math.isnan(old) else min(old, d)
    return out


@pytest.mark.parametrize("block, strip", [(4096, 512), (16, 5)])
def test_nearest_in_cell_is_all_pairs(spark, monkeypatch, block, strip):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "STRIP", strip)
    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 2, None]), [r.choice([r.gauss(0, 1), float(r.randrange(2))]) for _ in range(3)]) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(i, 2, [0.5, 0.25, 1e-9 * i]) for i in range(5)] + [(7, 1, rows[7][2]), (7, 1, rows[7][2])]
    inf, nan = float("inf"), float("nan")
    rows += [(300, 3, [1.0, 2.0]), (301, 3, [1e8, 1e8]), (302, 3, [1e8, 1e8 + 1e-7]), (303, 3, [1.0]), (304, 3, None), (305, 3, [1.0, None]), (306, 4, [1.0]), (None, 4, [1.0])]
    rows += [(310, 5, [inf, 0.0]), (311, 5, [nan, 0.0]), (312, 5, [1e200, 0.0]), (313, 6, [inf]), (314, 6, [inf]), (315, 7, [2.0]), (316, 7, [inf]), (320, 8, [1.0]), (320, 8, [3.0]), ((1 << 60) + 1, 9, [1.0]), ((1 << 60) + 2, 9, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    got = {x.vec_id: x.nearest for x in J.nearest_in_cell(df, "label", "vec_id", "v").collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, d in want.items():
        assert got[i] == d or (d is not None and got[i] is not None and (math.isclose(got[i], d, rel_tol=1e-12) or math.isnan(d) and math.isnan(got[i]))), (i, got[i], d)


def test_pairs_are_blocks_of_vectors(spark):
    x = np.random.default_rng(5).normal(size=(12_000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, v array<float>").repartition(4)
    out = J.nearest_in_cell(df, "label", "vec_id", "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan  # no row for a pair of vectors
    got = {r.vec_id: r.nearest for r in out.collect()}
    y = x.astype(float)
    for i in range(0, 12_000, 1501):
        d = np.sqrt(((y - y[i]) ** 2).sum(1))
        d[i] = np.inf
        assert math.isclose(got[i], d.min(), rel_tol=1e-12)
