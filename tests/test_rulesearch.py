"""The rule search against a plain loop over rows and rules, and its choice."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rulesearch as RS


def nmi(pairs):
    n = len(pairs)
    joint, a, b = Counter(pairs), Counter(p for p, _ in pairs), Counter(t for _, t in pairs)
    told = sum(c / n * math.log(c * n / (a[x] * b[y])) for (x, y), c in joint.items())
    h = math.prod(-sum(c / n * math.log(c / n) for c in m.values()) for m in (a, b))
    return told / math.sqrt(h) if h > 0 else 0.0


def step(now, large, confidence, hysteresis):
    leave = 0.5 + hysteresis * (confidence - 0.5)
    if now == "large" and large >= leave or now == "small" and 1 - large >= leave:
        return now
    return "large" if large >= confidence else "small" if 1 - large >= confidence else "uncertain"


def test_sizes_by_a_plain_loop(spark):
    draw = random.Random(6)
    rows = [(k, t, (p := draw.random()), p * 2 + draw.random()) for k in ("u", None) for t in range(120)]
    table = spark.createDataFrame(rows, "k string, open_time_ms long, large double, size double").withColumn("boundary", F.explode(F.array(F.lit(0.8), F.lit(1.5))))
    got = {(r["k"], r["boundary"], r["confidence"], r["hysteresis"]): r for r in RS.magnitude_rules(table, ["k"]).collect()}
    assert len(got) == 2 * 2 * 12
    for k in ("u", None):
        best = None
        for boundary in (0.8, 1.5):
            for c in RS.SIZE_CONFIDENCES:
                for h in RS.HYSTERESES:
                    now, pairs, switches = None, [], 0
                    for _, _, large, size in (r for r in rows if r[0] == k):
                        new = step(now, large, c, h)
                        switches += now is not None and new != now
                        now = new
                        pairs.append((now, size >= boundary))
                    r = got[k, boundary, c, h]
                    assert (r["switches"], r["support"]) == (switches, sum(p != "uncertain" for p, _ in pairs))
                    assert r["nmi"] == pytest.approx(nmi(pairs), abs=1e-9)
                    rank = (-round(nmi(pairs), 12), switches, c, boundary, c, h)
                    if best is None or rank < best[0]:
                        best = rank, (boundary, c, h)
        assert [q[1:] for q, r in got.items() if q[0] == k and r["chosen"]] == [best[1]]


def test_support_and_certain_outcomes(spark):
    rows = spark.range(100).select(F.lit("u").alias("k"), F.lit(1.0).alias("boundary"), F.col("id").alias("open_time_ms"), F.lit(0.52).alias("large"), F.lit(2.0).alias("size"))
    found = RS.magnitude_rules(rows, ["k"]).collect()
    assert not any(r["chosen"] for r in found) and all((r["nmi"], r["support"], r["switches"]) == (0.0, 0, 0) for r in found)
    sure = RS.magnitude_rules(rows.withColumn("large", F.lit(0.9)), ["k"]).where("chosen").collect()
    assert [(r["confidence"], r["hysteresis"], r["nmi"]) for r in sure] == [(0.55, 0.0, 0.0)]
    assert RS.magnitude_rules(rows.limit(0), ["k"]).collect() == []


def test_rows_are_shuffled_once(spark):
    rows = spark.range(50).select(F.lit("u").alias("k"), F.lit(0.1).alias("boundary"), F.col("id").alias("open_time_ms"), F.lit(0.5).alias("up"), F.lit(0.3).alias("balanced"), F.lit(0.2).alias("down"), F.lit(0.4).alias("lean"))
    plan = RS.direction_rules(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning(k") <= 6


def test_choices_of_ratios():
    found = RS.ratio_choices([("a", "b"), ("c",), ("d", "e")])
    assert found[:4] == [("a",), ("b",), ("c",), ("a", "c")] and ("b", "c", "e") in found
    assert len(found) == len(set(found)) == 3 * 2 * 3 - 1
    assert len(RS.ratio_choices([("a", "b")] * 3)) == 26


def test_volatility_and_endpoints_by_a_plain_loop(spark):
    draw = random.Random(8)
    some = lambda low, high: None if draw.random() < 0.05 else draw.uniform(low, high)
    rows = [("u", t, some(0.6, 2.2), some(0.6, 1.9), some(0.2, 0.8), draw.choice([True, False, None])) for t in range(150)]
    table = spark.createDataFrame(rows, "k string, open_time_ms long, a double, b double, p double, came boolean")
    got = {(r["threshold"], r["ratios"], r["hysteresis"]): r for r in RS.volatility_rules(table.withColumnRenamed("came", "high"), ["k"], [("a",), ("b",)]).collect()}
    assert len(got) == 4 * 3 * 3
    told, best = [r for r in rows if r[5] is not None], None
    for place, names in enumerate([("a",), ("b",), ("a", "b")]):
        for threshold in RS.THRESHOLDS:
            for h in RS.HYSTERESES:
                now, before, counts, exits, switches = False, None, Counter(), 0, 0
                for _, _, a, b, _, high in told:
                    values = [{"a": a, "b": b}[n] for n in names]
                    known = [v for v in values if v is not None]
                    now = any(v > threshold for v in known) or now and any(v >= 1 + h * (threshold - 1) for v in known)
                    counts[now, high] += 1
                    if before is not None and now != before:
                        switches += 1
                        exits += not now and high
                    before = now
                rate = lambda x: counts[x, x] / max(counts[x, x] + counts[not x, x], 1)
                r = got[threshold, "+".join(names), h]
                assert (r["false_exits"], r["exit_delay"], r["switches"]) == (exits, counts[True, False], switches)
                assert r["balanced_accuracy"] == pytest.approx((rate(True) + rate(False)) / 2)
                rank = (-round((rate(True) + rate(False)) / 2, 12), exits, counts[True, False], place, threshold, h)
                best = min(best or (rank, r), (rank, r), key=lambda x: x[0])
    assert best[1]["chosen"] and sum(r["chosen"] for r in got.values()) == 1
    for r in RS.endpoint_rules(table.withColumnRenamed("came", "rose"), ["k"]).collect():
        now, pairs = "uncertain", []
        leave = 0.5 + r["hysteresis"] * (r["entry"] - 0.5)
        for _, _, _, _, p, rose in told:
            if p is not None:
                held = now == "up" and p >= leave or now == "down" and p <= 1 - leave
                now = now if held else "up" if p >= r["entry"] else "down" if p <= 1 - r["entry"] else "uncertain"
            pairs.append((now, "up" if rose else "down"))
        sure = [x for x in pairs if x[0] != "uncertain"]
        assert r["support"] == len(sure) and r["coverage"] == pytest.approx(len(sure) / len(pairs))
        assert r["hit_rate"] == pytest.approx(sum(a == b for a, b in sure) / len(sure)) and r["nmi"] == pytest.approx(nmi(pairs), abs=1e-9)
