"""The archive search: a round against plain Python, reruns, restarts, and cells that never get worse."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators import paths as P

CENTRES = [(i * 3 + j, [0.3 + 0.2 * i, 0.3 + 0.2 * j]) for i in range(3) for j in range(3)]
UNIT = {c: (0.0, 1.0) for c in P.CHANNELS}


def judge(paths):
    vector = F.array(F.avg("g"), F.avg("b")).alias("vector")
    score = F.round(F.avg(F.col("u") - F.col("d")), 9)
    return paths.groupBy("path_id").agg(vector, F.when(F.max("u") > 0.2, score).alias("score"))


def setting(spark, n=25):
    ids = spark.range(n).select(F.col("id").alias("path_id"))
    return P.random_paths(ids, 8, UNIT, 3), spark.createDataFrame(CENTRES, "cell int, v array<double>")


def unit(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def best(rows):
    """rows: (path_id, round, [[g, b, u, d], ...])"""
    found = {}
    for name, number, path in rows:
        x = np.array(path)
        if x[:, 2].max() <= 0.2:
            continue
        v, score = x[:, :2].mean(0), round(float(np.mean(x[:, 2] - x[:, 3])), 9)
        cell = min((float(((v - np.array(c)) ** 2).sum()), k) for k, c in CENTRES)[1]
        found[cell] = min(found.get(cell, (9.0, 0, "", None)), (-score, number, name, path))
    return found


def listed(rows):
    out = {}
    for r in rows.orderBy("path_id", "idx").collect():
        out.setdefault(r["path_id"], []).append([r[c] for c in P.CHANNELS])
    return out


def test_one_round_by_hand(spark, tmp_path):
    starts, centres = setting(spark)
    got = {r["cell"]: r for r in A.evolved(starts, judge, centres, 1, 40, 7, folder=f"file://{tmp_path}/a").collect()}
    first = best([(str(k), 0, p) for k, p in listed(starts).items()])
    zero = {r["cell"]: r["path_id"] for r in spark.read.parquet(f"file://{tmp_path}/a/round-0").collect()}
    assert zero == {c: b[2] for c, b in first.items()}
    holders = [first[c][2] for c in sorted(first)]
    n, plan = len(holders), []
    assert n > 2
    for i in range(40):
        p = int(unit(7, 1, i, "parent") * n)
        plan.append((f"1:{i}", A.OPERATIONS[i % 5], holders[p], holders[(p + 1 + int(unit(7, 1, i, "other") * (n - 1))) % n]))
    archive = spark.read.parquet(f"file://{tmp_path}/a/round-0")
    assert sorted(map(tuple, A.plan_of(archive, 1, 40, 7).collect())) == sorted(plan)
    assert all(p[2] != p[3] for p in plan)
    texts = starts.withColumn("path_id", F.col("path_id").cast("string"))
    children = P.varied(texts, spark.createDataFrame(plan, "child_id string, operation string, parent string, other string"), 7).withColumnRenamed("child_id", "path_id")
    want = best([(c[2], c[1], c[3]) for c in first.values()] + [(k, 1, p) for k, p in listed(children).items()])
    assert set(got) == set(want)
    for cell, (score, number, name, path) in want.items():
        r = got[cell]
        assert (r["path_id"], r["round"]) == (name, number) and r["score"] == pytest.approx(-score, abs=1e-8)
        assert [[x[c] for c in P.CHANNELS] for x in r["path"]] == path
    assert any(r["round"] == 1 and r["parent"] for r in got.values())


def test_reruns_restarts_and_no_cell_gets_worse(spark, tmp_path):
    starts, centres = setting(spark)
    base = f"file://{tmp_path}/a"
    once = sorted(map(str, A.evolved(starts, judge, centres, 4, 30, 1, folder=base).collect()))
    scores = [{r["cell"]: r["score"] for r in spark.read.parquet(f"{base}/round-{k}").collect()} for k in range(5)]
    for a, b in zip(scores, scores[1:]):
        assert all(b[c] >= s for c, s in a.items())
    assert sum(scores[4].values()) > sum(scores[0].values())
    other = f"file://{tmp_path}/b"
    A.evolved(starts, judge, centres, 2, 30, 1, folder=other)

    def only_later(paths):
        assert paths.columns[0] == "path_id"
        return judge(paths)

    assert sorted(map(str, A.evolved(starts, only_later, centres, 4, 30, 1, folder=other).collect())) == once


def test_one_cell_and_none(spark, tmp_path):
    starts, centres = setting(spark, 3)
    one = A.evolved(starts, judge, centres.where("cell = 4"), 1, 10, 2, folder=f"file://{tmp_path}/a").collect()
    assert len(one) == 1 and one[0]["cell"] == 4
    assert A.evolved(starts.limit(0), judge, centres, 1, 10, 2, folder=f"file://{tmp_path}/b").collect() == []
    with pytest.raises(ValueError, match="centres"):
        A.evolved(starts, judge, centres.limit(0), 1, 10, 2, folder=f"file://{tmp_path}/c")
