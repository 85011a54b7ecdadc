"""Operators against hand-worked values and plain Python: calendars, performance, folds, states, paths, samples, models."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks as C
from tidemark.functions import hashing as H
from tidemark.functions import scalar as X
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import learning as L
from tidemark.operators import paths as P
from tidemark.operators import performance as PF
from tidemark.operators import resample as RS
from tidemark.operators import robust as R
from tidemark.operators import sampling as G
from tidemark.operators import search
from tidemark.operators import simulate as S
from tidemark.operators import states as W
from tidemark.operators import strategy as B
from tidemark.operators import skyline
from tidemark.sources import upsert

DAY = 86_400_000
BARS = "open_time_ms long, open double, high double, low double, close double, volume double"


def bars_from(spark, closes, start=0, step=DAY):
    rows = [(start + i * step, c, c * 1.01, c * 0.99, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=1, vol=0.02):
    r = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(0.0003, vol)))
    return out


# calendars and resampling


def test_taipei_week_and_new_york_month(spark):
    at = 1387760400000  # 2013-12-23 01:00 UTC
    rows = [(at, 9.1, 9.2, 9.05, 9.1, 1.0), (at + DAY, 9.1, 9.3, 9.1, 9.2, 2.0), (at + 2 * DAY, 9.2, 9.25, 9.15, 9.24, 3.0)]
    week = RS.resample(spark.createDataFrame(rows, BARS), [], "week", "Asia/Taipei").first()
    assert (week.open, week.high, week.low, week.close, week.volume) == (9.1, 9.3, 9.05, 9.24, 6.0)
    assert week.open_time_ms == 1387728000000  # 2013-12-22 16:00 UTC
    assert RS.resample(spark.createDataFrame(rows, BARS), [], "week", "Asia/Taipei", at + 3 * DAY).count() == 0
    may = 1777901400000  # 2026-05-04 13:30 UTC
    month = RS.resample(spark.createDataFrame([(may, 10.0, 13.0, 9.0, 12.0, 3.0)], BARS), [], "month", "America/New_York").first()
    assert month.open_time_ms == 1777608000000  # 2026-05-01 04:00 UTC


def test_back_adjustment_scales_all_earlier_rows(spark):
    rows = [(0, 3.8, 4.4, 3.6, 4.0, 1.0), (DAY, 1.0, 1.1, 0.9, 1.0, 1.0), (2 * DAY, 1.1, 1.2, 1.0, 1.2, 1.0)]
    first = RS.back_adjusted(spark.createDataFrame(rows, BARS), []).orderBy("open_time_ms").first()
    assert [round(first[c], 9) for c in ("open", "high", "low", "close")] == [0.95, 1.1, 0.9, 1.0]


def test_leveraged_child(spark):
    rows = [(0, 110.0, 0.0, 0.0, 120.0, 0.0, 100.0), (DAY, 126.0, 0.0, 0.0, 108.0, 0.0, 100.0)]
    got = RS.leveraged(spark.createDataFrame(rows, BARS + ", previous_close double"), [], 2.0).orderBy("open_time_ms").collect()
    assert [(round(r.open, 6), round(r.close, 6)) for r in got] == [(12000.0, 14000.0), (15400.0, 11200.0)]


# joins


@pytest.mark.parametrize("delay,expected", [(0, (4, 0, 2)), (1, (3, 1, 2))])
def test_as_of_counts(spark, delay, expected):
    timeline = spark.createDataFrame([(d * DAY,) for d in range(1, 5)], "time_ms long")
    series = spark.createDataFrame([(d * DAY, (d + delay) * DAY, float(d)) for d in (1, 3)], "time_ms long, avail_ms long, value double")
    got = J.alignment_summary(J.as_of(timeline, series, []), []).first()
    assert got.missing == expected[1] and got.aligned == expected[0]


def test_as_of_is_brute_force(spark):
    r = random.Random(3)
    series = [(t, t + r.randrange(0, 40), float(t)) for t in sorted(r.sample(range(200), 60))]
    times = sorted(r.sample(range(240), 80))
    got = {x.time_ms: x.matched_ms for x in J.as_of(spark.createDataFrame([(t,) for t in times], "time_ms long"), spark.createDataFrame(series, "time_ms long, avail_ms long, value double"), []).collect()}
    for t in times:
        assert got[t] == max((s for s, a, _ in series if s <= t and a <= t), default=None)


def test_pareto_is_brute_force(spark):
    r = random.Random(5)
    points = [(i, float(r.randrange(12)), float(r.randrange(12))) for i in range(200)]
    got = {x.id for x in skyline.pareto(spark.createDataFrame(points, "id int, a double, b double"), [], ["a", "b"], "id").collect()}
    want = {i for i, a, b in points if not any(c >= a and d >= b and (c > a or d > b) for _, c, d in points)}
    assert got == want


# performance


def test_report_values(spark):
    path = spark.createDataFrame([(i * DAY, v, e) for i, (v, e) in enumerate([(100.0, 0.0), (110.0, 0.5), (99.0, 0.5), (121.0, 1.0)])], "open_time_ms long, nav double, actual_exposure double")
    acc = PF.accumulation(path, []).orderBy("open_time_ms").collect()[-1]
    assert acc.arithmetic == pytest.approx(0.1 - 0.1 + 121 / 99 - 1) and acc.compounded == pytest.approx(0.21)
    spell = PF.underwater_spells(path, []).collect()
    assert len(spell) == 1 and spell[0].days == 1 and spell[0].recovered
    e = PF.exposure(path, []).first()
    assert (e.exposed_ratio, e.average_exposure, round(e.adjusted_return, 9)) == (0.75, 0.5, 0.42)
    bins = PF.histogram(PF.period_returns(path, [], "day"), [], "ret").count()
    assert bins == 3


# folds


def reference_replay(rows, spec):
    cash, q, pending, navs = spec.initial, 0.0, None, []
    for o, c, t in rows:
        if pending is not None:
            gap = pending * (cash + q * o) - q * o
            if gap > 1e-12:
                q, cash = q + min(gap, cash) / o, cash - min(gap, cash)
            elif gap < -1e-12:
                q, cash = q + gap / o, cash - gap
        pending = t
        navs.append(cash + q * c)
    return navs


def test_replay_never_looks_ahead_and_matches_plain_python(spark):
    closes = walk(40)
    targets = [(i * 37 % 11) / 10 for i in range(40)]
    rows = [(i * DAY, c * 0.999, c, c, c, 1.0, t) for i, (c, t) in enumerate(zip(closes, targets))]
    df = spark.createDataFrame(rows, BARS + ", target double")
    got = [r.nav for r in S.replay_exposure(df, []).orderBy("open_time_ms").collect()]
    assert got == pytest.approx(reference_replay([(r[1], r[4], r[6]) for r in rows], S.ReplaySpec()))
    changed = [(*r[:6], 0.0 if i == 39 else r[6]) for i, r in enumerate(rows)]
    assert [r.nav for r in S.replay_exposure(spark.createDataFrame(changed, BARS + ", target double"), []).orderBy("open_time_ms").collect()] == pytest.approx(got)


def test_replay_fixture(spark):
    df = bars_from(spark, [100.0, 110.0]).withColumn("target", F.lit(0.5))
    last = S.replay_exposure(df, [], S.ReplaySpec(1000.0, mode="same_close")).orderBy("open_time_ms").collect()[-1]
    assert last.nav == pytest.approx(1050.0) and last.trades == 2


def test_open_buy_close_sell_earns_the_day(spark):
    rows = [(i * DAY, 10.0, 11.0, 9.0, 11.0, 1.0, 0.3) for i in range(3)]
    path = S.replay_exposure(spark.createDataFrame(rows, BARS + ", target double"), [], S.ReplaySpec(1000.0, mode="open_buy_close_sell")).orderBy("open_time_ms").collect()
    assert [r.nav for r in path] == pytest.approx([1100.0, 1210.0, 1331.0]) and all(r.exposure == 0 for r in path)


def test_lots_are_released_in_order_and_split(spark):
    lots = spark.createDataFrame([("k", 1, 2.0, True), ("k", 2, 5.0, False), ("k", 3, 4.0, True), ("k", 4, 1.0, True)], "k string, at int, amount double, ok boolean")
    got = [(r.released, r.kept) for r in S.released_lots(lots, ["k"], F.lit(3.5), ["at"], eligible=F.col("ok")).orderBy("at").collect()]
    assert got == [(2.0, 0.0), (0.0, 5.0), (1.5, 2.5), (0.0, 1.0)]


def test_region_parameters_fall_back_to_the_first(spark):
    rows, packs = spark.createDataFrame([("a",), ("b",), (None,)], "region string"), spark.createDataFrame([("a", 1.0), ("c", 9.0)], "region string, beta double")
    assert {(r.region, r.beta) for r in S.with_region_parameters(rows, packs, first="c").collect()} == {("a", 1.0), ("b", 9.0), (None, 9.0)}


def runs(spark, **values):
    names = ["run_id", *values]
    return spark.createDataFrame([tuple([1, *values.values()])], ", ".join(["run_id int", *[f"{n} double" for n in values]])).select(*names)


def test_strategy_waits_for_history_and_holds_cash(spark):
    path = B.backtest(bars_from(spark, walk(112)), [], runs(spark, beta=2.0), B.Spec(initial=500.0)).collect()
    assert len(path) == 112 and {r.nav for r in path} == {500.0} and sum(r.trades for r in path) == 0


def test_strategy_is_causal_and_conserves_value(spark):
    closes = walk(220, 7)
    spec = B.Spec(initial=10_000.0, monthly=50.0, fee=0.001, spread=0.0005)
    whole = B.backtest(bars_from(spark, closes), [], runs(spark, beta=3.0), spec).orderBy("open_time_ms").collect()
    part = B.backtest(bars_from(spark, closes[:180]), [], runs(spark, beta=3.0), spec).orderBy("open_time_ms").collect()
    assert [r.nav for r in whole[:180]] == pytest.approx([r.nav for r in part])
    for r, c in zip(whole, closes):
        assert r.nav == pytest.approx(r.cash + r.quantity * c) and 0 <= r.exposure <= 1 and r.cash >= -1e-9
    assert sum(r.trades for r in whole) > 0 and sum(r.costs for r in whole) > 0


def test_strategy_thresholds(spark):
    closes = walk(200, 9)
    full = B.backtest(bars_from(spark, closes), [], runs(spark, force_full_threshold=0.0), B.Spec()).orderBy("open_time_ms").collect()
    assert full[-1].target == 1.0 and full[-1].exposure > 0.99
    still = B.backtest(bars_from(spark, closes), [], runs(spark, rebalance_threshold=1.0), B.Spec(floating_only=True)).collect()
    assert sum(r.trades for r in still) == 0
    assert B.backtest(bars_from(spark, closes), [], runs(spark, force_full_threshold=0.1, force_empty_threshold=0.9), B.Spec()).count() == 0


def test_filter_goes_to_cash_and_returns(spark):
    closes = [100 + i * 0.2 for i in range(200)] + [140 - i * 0.3 for i in range(150)] + [95 + i * 0.5 for i in range(200)]
    path = B.backtest(bars_from(spark, closes), [], runs(spark, force_full_threshold=0.0), B.Spec(filter_months=2)).orderBy("open_time_ms").collect()
    off = [r for r in path if r.risk_off]
    assert off and all(r.quantity == pytest.approx(0.0) for r in off) and all(r.practical_exposure > 0.9 for r in off)
    assert not path[-1].risk_off and path[-1].exposure > 0.5


def test_account_releases_stack_before_selling():
    a = B.Account(0.0)
    a.stack = 10.0
    a.execute({"release": 4.0, "macro": 0.0, "micro": 0.0, "sell": 6.0}, 2.0, B.Spec())
    assert (a.stack, a.free, a.cash) == (6.0, 0.0, 8.0)


def test_evolution_is_reproducible_and_never_gets_worse(spark):
    bars = bars_from(spark, walk(260, 4))
    config = search.Config(population=4, generations=1, elites=1, seed=3)
    a, b = search.evolve(bars, config, B.Spec(monthly=10.0)), search.evolve(bars, config, B.Spec(monthly=10.0))
    assert a == b and a[2] == sorted(a[2])


# states


def test_hysteresis_is_the_fold(spark):
    r = random.Random(8)
    p = [round(r.random(), 3) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "open_time_ms long, p double")
    got = [x.s for x in df.select("open_time_ms", W.direction(F.col("p"), [], 0.65, 0.4).alias("s")).orderBy("open_time_ms").collect()]
    now, leave, want = "uncertain", 0.5 + 0.4 * 0.15, []
    for x in p:
        if not ((now == "up" and x >= leave) or (now == "down" and x <= 1 - leave)):
            now = "up" if x >= 0.65 else "down" if x <= 0.35 else "uncertain"
        want.append(now)
    assert got == want


def test_space_direction_is_the_fold(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        x = [r.random() ** 2 for _ in range(3)]
        rows.append((i, *[v / sum(x) for v in x]))
    df = spark.createDataFrame(rows, "open_time_ms long, up double, balanced double, down double")
    got = [x.s for x in df.select("open_time_ms", W.space_direction({k: F.col(k) for k in ("up", "balanced", "down")}, [], 0.5, 0.1, 0.5).alias("s")).orderBy("open_time_ms").collect()]
    now, want = "uncertain", []
    for _, *x in rows:
        p = dict(zip(("up", "balanced", "down"), x))
        second = lambda k: max(v for n, v in p.items() if n != k)
        if not (now in p and p[now] >= 1 / 3 + 0.5 * (0.5 - 1 / 3) and p[now] - second(now) >= 0.05):
            best = max(p, key=p.get)
            now = best if p[best] >= 0.5 and p[best] - second(best) >= 0.1 else "uncertain"
        want.append(now)
    assert got == want


def hull(points):
    points = sorted(set(points))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = half(points) + half(points[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1]))) / 2


def test_hull_area_and_slope(spark):
    closes = walk(30, 6, 0.1)
    rows = W.geometry(bars_from(spark, closes), [], 6, 0).orderBy("open_time_ms").collect()
    assert all(r.area is None for r in rows[:6])
    for i in range(6, 30):
        want = hull([(float(k), closes[i - 6 + k] * f) for k in range(7) for f in (0.99, 1.01)])
        assert rows[i].area == pytest.approx(want)
        assert rows[i].slope == pytest.approx(np.polyfit(range(7), closes[i - 6 : i + 1], 1)[0])


# paths


def test_behaviour_fixture(spark):
    df = spark.createDataFrame([("p", 0, 0.1, 0.2, 0.3, 0.4), ("p", 1, -0.1, -0.2, 0.1, 0.2)], "id string, idx int, g double, b double, u double, d double")
    got = P.behaviour(df, ["id"]).first()
    assert [got[f] for f in P.FEATURES] == pytest.approx([0, 0, 0.5, 0.5, 1, 0.7, 4 / 49, 1 / 3, 5 / 7, -0.2])


def test_recomposition_fixture(spark):
    segments = spark.createDataFrame([("p", "a", 0, 1, None), ("p", "b", 1, 2, 200.0)], "plan string, item string, position int, repeats int, previous_close double")
    bars = spark.createDataFrame([("p", "a", 0, 100.0, 110.0, 95.0, 100.0, 5.0), ("p", "b", 0, 210.0, 220.0, 205.0, 215.0, 7.0)], "plan string, item string, ordinal int, open double, high double, low double, close double, volume double")
    slots = spark.createDataFrame([("p", i, i * DAY) for i in range(3)], "plan string, ordinal int, open_time_ms long")
    made, instances = P.recompose(segments, bars, slots)
    rows = made.orderBy("ordinal").collect()
    assert [rows[1][c] for c in ("open", "high", "low", "close", "volume")] == [105.0, 110.0, 102.5, 107.5, 7.0]
    assert rows[2].open == pytest.approx(210 * 107.5 / 200)
    assert [r.multiplier for r in instances.orderBy("instance").collect()] == pytest.approx([1.0, 0.5, 107.5 / 200])
    assert instances.where("anchor_missing").count() == 1


def test_distance_is_brute_force(spark):
    r = random.Random(4)
    n = 13
    a, b = ([[r.random() for _ in range(4)] for _ in range(n)] for _ in range(2))
    make = lambda x: spark.createDataFrame([("k", i, *v) for i, v in enumerate(x)], "id string, idx int, g double, b double, u double, d double")

    def rms(x, y):
        m, scales, s, k = len(x), [], 1, 0
        while s < m:
            scales.append(s)
            s *= 2
        total = 0.0
        for s in [*scales, m]:
            for p in range(s):
                lo, hi = p * m // s, (p + 1) * m // s
                total += sum((np.mean(x[lo:hi], 0) - np.mean(y[lo:hi], 0)) ** 2)
                k += 4
        return math.sqrt(total / k)

    got = P.path_distance(make(a), make(b), ["id"], 5).first()
    dw, dh = rms(np.array(a[:5]), np.array(b[:5])), rms(np.array(a[5:]), np.array(b[5:]))
    assert (got.warmup_distance, got.evaluation_distance, got.distance) == pytest.approx((dw, dh, math.sqrt((dw * dw + dh * dh) / 2)))


def test_perturbation_keeps_bars_valid(spark):
    draws = spark.createDataFrame([(1, 0.3), (2, 0.3)], "seed int, alpha double")
    p = P.perturbed(bars_from(spark, walk(60)), [], draws)
    assert p.where(~X.valid_ohlc(*[F.col(c) for c in ("open", "high", "low", "close")])).count() == 0
    again = P.perturbed(bars_from(spark, walk(60)), [], draws.where("seed = 1"))
    assert again.exceptAll(p).count() == 0


def test_varied_paths_stay_in_the_unit_cube(spark):
    ids = spark.range(20).select(F.col("id").alias("path_id"))
    paths = P.random_paths(ids, 12, {c: (0.0, 1.0) for c in P.CHANNELS}, 1)
    plan = ids.select(F.col("path_id").alias("child_id"), F.get(F.array(*map(F.lit, P.quotas(5))), (F.col("path_id") % 5).cast("int")).alias("operation"), F.col("path_id").alias("parent"), ((F.col("path_id") + 1) % 20).alias("other"))
    made = P.varied(paths, plan, 2)
    assert made.count() == 240
    assert made.where(" OR ".join(f"{c} NOT BETWEEN 0 AND 1" for c in P.CHANNELS)).count() == 0
    assert P.quotas(7) == {"global": 2, "local": 2, "block": 1, "crossover": 1, "directional": 1}


def test_varied_draws_once_a_child_and_brings_parents(spark):
    ids = spark.range(40).select(F.col("id").alias("path_id"))
    paths = P.random_paths(ids, 12, {c: (0.0, 1.0) for c in P.CHANNELS}, 1).localCheckpoint()
    names = F.array(*map(F.lit, P.quotas(5)))
    plan = ids.select(F.col("path_id").alias("child_id"), F.get(names, (F.col("path_id") % 5).cast("int")).alias("operation"), F.col("path_id").alias("parent"), F.when(F.col("path_id") % 3 > 0, (F.col("path_id") + 1) % 40).alias("other")).localCheckpoint()
    made = P.varied(paths, plan, 2, parents=True)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sha2(") <= 2 * (3 + 2 * 4)  # children alone and with another parent
    old = {(r.path_id, r.idx): r for r in paths.collect()}
    draw = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13
    fold = lambda x: min(x % 2, 2 - x % 2)
    rows = made.collect()
    assert len(rows) == 480
    for r in rows:
        i, mine = r.child_id, old[r.child_id, r.idx]
        other = (i + 1) % 40 if i % 3 else None
        op = "global" if other is None and r.operation in ("crossover", "directional") else r.operation
        n = 12 if op in ("global", "directional") else 1 + int(draw(2, i, 0) * 3) if op == "local" else 2 ** int(draw(2, i, 0) * 4)
        start = int(draw(2, i, 1) * (12 - n + 1))
        for k, c in enumerate(P.CHANNELS):
            assert r[f"p_{c}"] == mine[c]
            want = mine[c]
            if start <= r.idx < start + n:
                theirs = old[other, r.idx][c] if other is not None else 0.0
                moved = want + 0.1 * (2 * draw(2, i, 2, r.idx, c) - 1)
                want = {"global": draw(2, i, 3, r.idx, c), "crossover": theirs, "directional": want + 0.1 * (want - theirs), "local": moved if int(draw(2, i, 4) * 4) == k else want, "block": moved}[op]
            assert math.isclose(r[c], fold(want), abs_tol=1e-12), (i, r.idx, c, op)


def test_children_of_random_paths_are_drawn_where_they_are_taken(spark):
    odd = [(None,), (-3,), (5,), (5,), (7,), (7,), (7,)]
    ids = spark.range(60).select(F.col("id").alias("path_id")).unionByName(spark.createDataFrame(odd, "path_id long"))
    names = F.array(*map(F.lit, [*P.quotas(5), None]))
    other = F.when(F.col("path_id") % 4 > 0, F.col("path_id") + F.when(F.col("path_id") % 9 == 0, 1000).otherwise(-2))  # some are no path
    plan = ids.select(F.col("path_id").alias("child_id"), F.get(names, F.pmod("path_id", F.lit(6)).cast("int")).alias("operation"), F.col("path_id").alias("parent"), other.alias("other"))
    plan = plan.unionByName(spark.createDataFrame([(900, "block", 800, None), (901, "crossover", 3, 7), (902, "directional", 7, 5), (903, "none", 4, 8)], plan.schema)).localCheckpoint()
    for bounds in ({c: (0.0, 1.0) for c in P.CHANNELS}, {"g": (-0.5, 0.5), "b": (0.0, 1.0), "u": (0.2, 0.3), "d": (0.5, 1.5)}):
        for probe in ({}, {"scope": (4, 6), "lengths": (2, 3)}):
            made = P.varied_random(ids, 12, bounds, 1, plan, 2, 0.2, parents=True, **probe)
            want = P.varied(P.random_paths(ids, 12, bounds, 1), plan, 2, 0.2, parents=True, **probe)
            got = sorted(map(tuple, made.select(want.columns).collect()), key=str)
            assert got == sorted(map(tuple, want.collect()), key=str)
            assert any(r[0] == 901 for r in got) and not any(r[0] in (None, 900) for r in got)
    plan_text = made._jdf.queryExecution().optimizedPlan().toString()
    above = plan_text[: plan_text.index("Generate explode")]
    assert "Join" not in above and "Repartition" not in above  # ids meet, rows do not
    from tidemark import catalog

    query = catalog.QUERIES["g11_varied_paths"](spark, "/root/testdata/sf0.001")
    assert all(x.endswith("/orders.parquet") for x in query.inputFiles())  # no table of paths is written


def test_probes_change_one_run_in_scope(spark):
    ids = spark.range(12).select(F.col("id").alias("path_id"))
    paths = P.random_paths(ids, 12, {c: (0.0, 1.0) for c in P.CHANNELS}, 1)
    plan = ids.select(F.col("path_id").alias("child_id"), F.lit("block").alias("operation"), F.col("path_id").alias("parent"), F.lit(None).cast("long").alias("other"))
    made = P.varied(paths, plan, 2, scope=(4, 6), lengths=(2, 3)).join(paths.select(F.col("path_id").alias("child_id"), "idx", F.col("g").alias("old")), ["child_id", "idx"]).where("g != old")
    spans = made.groupBy("child_id").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(spans) == 12 and all(r.a >= 4 and r.b < 10 and 2 <= r.n <= 3 and r.b - r.a + 1 == r.n for r in spans)


# samples


def test_sobol_fills_each_dimension_evenly(spark):
    rows = spark.range(64).select(*[G.sobol(F.col("id"), k).alias(f"d{k}") for k in range(20)]).collect()
    for k in range(20):
        assert sorted(int(r[k] * 64) for r in rows) == list(range(64))
    assert [round(r[0], 4) for r in rows[:4]] == [0.0, 0.5, 0.75, 0.25]


def test_samples_begin_with_shorter_ones(spark):
    grid = {"a": (0, 5), "b": (0, 7)}
    for make in (lambda n: G.halton_sample(spark, grid, n), lambda n: G.discrete_sample(spark, grid, n, 3)):
        long, short = ([tuple(r)[1:] for r in make(n).collect()] for n in (20, 8))
        assert sorted(long)[:0] == [] and set(short) <= set(long) and len(set(long)) == 20
    plan = G.global_plan(spark, grid, {"a": 2, "b": 2}, 30)
    assert plan.count() == plan.select("a", "b").distinct().count() and plan.where("origin = 'sobol'").count() == 30
    assert G.global_plan(spark, grid, {"a": 2, "b": 2}, 48).count() == 48
    assert G.initial_sobol_count(3) == 64 and G.initial_sobol_count(5) == 128
    assert G.axis_values(1.0, 0.9, 2.0, 0.1, 2) == [0.9, 1.0, 1.1, 1.2]
    assert G.region_keys({"f": [1.0], "g": []}) == ["f=0;g=0", "f=1;g=0"]


def test_shuffles_keep_the_values(spark):
    df = spark.createDataFrame([("k", i, float(i % 3)) for i in range(30)], "k string, i int, v double")
    rows = G.shuffled(df, ["k"], "i", "v", 1, 2).orderBy("sequence", "i").collect()
    for s in (0, 1):
        assert sorted(r.v for r in rows if r.sequence == s) == sorted(float(i % 3) for i in range(30))
    assert [r.v for r in rows if r.sequence == 0] != [r.v for r in rows if r.sequence == 1]


# robustness


def test_region_analysis(spark):
    rows = []
    for x in range(5):
        for y in range(5):
            good = 1 <= x <= 3 and 1 <= y <= 3
            rows.append((f"{x}:{y}", x, y, "qualified" if good else "unqualified", 1.0 - abs(x - 2) * 0.1 if good else -1.0, 0.5 - abs(y - 2) * 0.1, 0.0))
    points = spark.createDataFrame(rows, "id string, x int, y int, state string, log_ratio double, log_residual double, composite double")
    bounds = {"x": (0, 4, True, True), "y": (0, 4, True, True)}
    walk_up = {(r.x, r.y): (r.steps, r.stop) for r in R.tolerance(points, bounds).where("axis = 'x' AND direction = 'up'").collect()}
    assert walk_up[1, 2] == (2, "observed_failure") and walk_up[3, 3] == (0, "observed_failure")
    costs = {(r.x, r.y): r.cost for r in R.medoid_costs(points.where("state = 'qualified'"), ["x", "y"]).collect()}
    assert costs[2, 2] == 12 and costs[1, 1] == 18
    found = {r.id: r.roles for r in R.analyse(points, bounds).collect()}
    assert "robust_center" in found["2:2"] and "return_leader" in found["2:2"]


# models


def test_isotonic_is_pool_adjacent_violators(spark):
    r = random.Random(6)
    rows = [(r.random(), float(r.random() < 0.5)) for _ in range(200)]
    got = [x.value for x in L.isotonic_calibrator(spark.createDataFrame(rows, "p double, y double"), [], "p", "y").orderBy("bin").collect()]
    rate = sum(y for _, y in rows) / len(rows)
    blocks = []
    for b in range(10):
        ys = [y for p, y in rows if min(int(p * 10), 9) == b]
        blocks.append([sum(ys) + 2 * rate, len(ys) + 2.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + n]
    want = [s / w for s, w, n in blocks for _ in range(n)]
    assert got == pytest.approx(want)


def test_normal_cdf_and_quantile(spark):
    xs = [-8.0, -3.3, -1.0, -0.2, 0.0, 0.7, 2.5, 6.9, 7.5]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.normal_cdf(F.col("x")).alias("p")).orderBy("x").collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=1e-9)


def test_six_regions_sum_to_one(spark):
    m = spark.createDataFrame([(1, "zero", 0.2, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0), (1, "both", 0.8, 1.0, 0.0, 0.0, 0.5, 0.5, 0.0)], "id int, kind string, mass double, weight double, mean_up double, mean_down double, var_up double, var_down double, cov double")
    r = L.six_regions(m, ["id"], 0.2, 1.0, 512).first().asDict()
    del r["id"]
    assert sum(r.values()) == pytest.approx(1.0) and r["balanced_small"] > 0.2
    assert abs(r["up_large"] - r["down_large"]) < 0.02


def test_least_squares_and_activity_scale(spark):
    r = np.random.default_rng(1)
    x = r.lognormal(size=(300, 3))
    y = 2 * x[:, 0] ** 0.7 * x[:, 1] ** 0.3 * r.lognormal(sigma=0.05, size=300)
    df = spark.createDataFrame([(i, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, y double")
    m = L.activity_scale(df, ["a", "b", "c"], "y", "i", 3000)
    assert m["weights"] == pytest.approx({"a": 0.7, "b": 0.3}, abs=0.03) and m["constant"] == pytest.approx(2.0, rel=0.05)


def test_simplex_projection():
    assert L.projected_on_simplex(np.array([0.5, 0.8, -1.0])) == pytest.approx([0.35, 0.65, 0.0])


def test_policy_modes(spark):
    df = spark.createDataFrame([(0.5, "up", "high"), (None, "down", "low")], "s double, direction string, volatility string")
    p = L.policy_value("continuous", 0.0, 1.0, 0.25, {"s": (2.0, 0.0)})
    assert [r[0] for r in df.select(p).collect()] == pytest.approx([1 / (1 + math.exp(-1)), 0.25])
    q = L.policy_value("six_state", 0.0, 1.0, 0.5, effects={"direction": {"up": 1.0, "down": -1.0}})
    assert [r[0] for r in df.select(q).collect()] == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.exp(1))])


def test_policy_signals_stay_within_bounds(spark):
    df = spark.createDataFrame([(0.8, 2.0, 1.0, 0.5), (1.2, 0.0, 1.0, 0.0)], "p double, ahead double, now double, ratio double")
    made = L.policy_signals({"direction": F.col("p")}, {"activity": (F.col("ahead"), F.col("now"), F.col("ratio"))}, F.lit(0.0))
    rows = [tuple(r) for r in df.select(*[c.alias(k) for k, c in made.items()]).collect()]
    assert rows[0] == pytest.approx((0.6, 0.0, 0.0)) and rows[1] == (None, None, 0.0)


# checks and identities


def test_lookup_needs_exactly_one_target(spark):
    rows, targets = spark.range(3), spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "id long, t double")
    assert C.lookup(rows, targets, ["id"]).count() == 3
    for bad in (targets.where("id < 2"), targets.union(targets.limit(1))):
        with pytest.raises(Exception, match="exactly one target"):
            C.lookup(rows, bad, ["id"]).collect()


def test_identities_change_only_with_content(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ('{"a":[1,2],"b":1}',), ("no json",)], "t string")
    got = [r[0] for r in df.select(H.canonical_json(F.col("t"))).collect()]
    assert got == ['{"a":[1,2],"b":1}'] * 2 + [None]
    rows = bars_from(spark, walk(30))
    a, b = H.dataset_hash(rows, [], "open_time_ms", ["close"], 7).first().hash, H.dataset_hash(rows.repartition(5), [], "open_time_ms", ["close"], 7).first().hash
    assert a == b != H.dataset_hash(rows.withColumn("close", F.col("close") + 1e-9), [], "open_time_ms", ["close"], 7).first().hash
    assert H.layered_key("x", {"a": 1, "b": 2}, "k", "j") == H.layered_key("x", {"b": 2, "a": 1}, "j", "k") != H.layered_key("x", {"a": 2, "b": 2}, "j", "k")


def test_canonical_decimal(spark):
    df = spark.createDataFrame([("1.500",), ("-0.0",), ("100",), ("x",), (" 0.10 ",)], "t string")
    assert [r[0] for r in df.select(X.canonical_decimal(F.col("t"))).collect()] == ["1.5", "0", "100", None, "0.1"]


def test_bounds_of_rounds_refuse_and_configurations_are_all_counted(spark):
    from tidemark.operators import grid, joins, robust

    points = spark.createDataFrame([(c, 0) for c in range(1100)] + [(0, 1)], "c int, k int")
    assert {(r.c, r.k) for r in joins.missing_by_configuration(points, "c", "k").collect()} == {(c, 1) for c in range(1, 1100)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "child long, parent long")
    root = spark.createDataFrame([(0,)], "child long")
    assert {(r.node, r.depth) for r in joins.ancestors(chain, root, "child", "parent", 4).collect()} == {(i, i) for i in range(1, 5)}
    with pytest.raises(ValueError):
        joins.ancestors(chain, root, "child", "parent", 3)
    line = spark.createDataFrame([(x, 0) for x in range(6)], "x int, y int")
    assert {r.cost for r in robust.medoid_costs(line, ["x", "y"], 5).collect()} == {15, 11, 9}
    with pytest.raises(ValueError):
        robust.medoid_costs(line, ["x", "y"], 4)
    assert {r.component for r in grid.grid_components(line, ["x", "y"], F.col("x").cast("long")).collect()} == {0}
    with pytest.raises(ValueError):
        grid.grid_components(line, ["x", "y"], F.col("x").cast("long"), 1)


# prices that are not positive


def test_zero_prices_give_nulls_and_do_not_count(spark):
    from tidemark.operators import indicators as I

    closes = [(10.0, 11.0, 9.0, 10.0), (10.0, 12.0, 10.0, 11.0), (0.0, 12.0, 0.0, 0.0), (11.0, 12.0, 11.0, 12.0), (12.0, 12.0, 12.0, 12.0), (0.0, 0.0, 0.0, 0.0), (12.0, 13.0, 11.0, 12.5)]
    df = spark.createDataFrame([(i * DAY, *row, 1.0) for i, row in enumerate(closes)], BARS)
    at = lambda rows, c: [r[c] for r in rows.orderBy("open_time_ms").collect()]
    made = I.coordinates(df, [])
    assert at(made, "open_time_ms") == [i * DAY for i in (1, 3, 4, 6)]
    assert at(made, "g") == pytest.approx([0.0, 0.0, 0.0, 0.0]) and at(made, "b")[1] == pytest.approx(math.log(12 / 11))
    assert at(I.true_range_log(df, []), "scale")[5] is None
    act = I.activity(df, [], 3)
    assert at(act, "hl_mean")[3] == pytest.approx((math.log(1.2) + math.log(12 / 11)) / 2)  # of rows 1 to 3; row 2 has no ratio
    targets = I.forward_targets(df, [], 2)
    assert at(targets, "up")[2] is None and at(targets, "down")[0] is None and at(targets, "up")[0] == pytest.approx(math.log(1.2))
    assert at(W.future_activity(df, [], 2), "future_hl_mean")[0] == pytest.approx(math.log(1.2))
    assert at(I.micro_signal(I.indicators(df, [])), "signal") == [None] * 7
    assert I.market_regime(I.indicators(df, [])).count() == 7
    navs = df.select("open_time_ms", F.col("close").alias("nav"))
    assert PF.report(navs, []).count() == 1
    back = RS.back_adjusted(df, []).orderBy("open_time_ms").collect()
    assert len(back) == 7 and all(math.isfinite(r["close"]) for r in back)


def test_chains_past_a_hundred_parents_and_configurations_past_a_thousand(spark):
    edges = spark.range(1, 121).select(F.col("id").alias("c"), (F.col("id") - 1).alias("p"))
    found = J.ancestors(edges, spark.createDataFrame([(120,)], "c long"), "c", "p")
    assert found.count() == 120 and found.agg(F.max("depth")).first()[0] == 120
    own = spark.range(1001).select(F.col("id").alias("config"), F.col("id").alias("key")).unionByName(spark.createDataFrame([(0, 5000)], "config long, key long"))
    missing = J.missing_by_configuration(own, "config", "key")
    assert missing.count() == 1001 * 1002 - 1002


@pytest.mark.parametrize("period", [2, 21, 300])
def test_ema_over_many_chunks(spark, period):
    rng = random.Random(period)
    xs = [rng.uniform(1, 9) * (1e6 if i < 50 else 1) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(xs)), "open_time_ms long, close double")
    got = [r["ema"] for r in I.ema(df, [], period, chunk=16).orderBy("open_time_ms").collect()]
    want, alpha = [xs[0]], 2 / (period + 1)
    for x in xs[1:]:
        want.append(alpha * x + (1 - alpha) * want[-1])
    assert got == pytest.approx(want, rel=1e-9)
    spoilt = I.ema(df.withColumn("close", F.when(F.col("open_time_ms") == 40, float("nan")).otherwise(F.col("close"))), [], period, chunk=16)
    assert [math.isnan(r["ema"]) for r in spoilt.orderBy("open_time_ms").collect()] == [i >= 40 for i in range(3000)]


def test_bar_rules_differ(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, 10.0, 12.0, 9.0, 11.0, 5.0),  # sound
        (0, 10.0, 12.0, 9.0, 11.0, 5.0),  # no time
        (1, 10.0, 10.5, 9.0, 11.0, 5.0),  # high below the close
        (1, 10.0, 12.0, 10.5, 11.0, 5.0),  # low above the open
        (1, 10.0, 12.0, 9.0, 11.0, -1.0),  # negative volume
        (1, 10.0, 12.0, 9.0, 11.0, nan),
        (1, 10.0, 12.0, 0.0, 11.0, 5.0),
        (1, nan, 12.0, 9.0, 11.0, 5.0),
        (1, 10.0, inf, 9.0, 11.0, 5.0),
        (1, None, 12.0, 9.0, 11.0, 5.0),
        (None, 10.0, 12.0, 9.0, 11.0, None),
    ]
    df = spark.createDataFrame(rows, BARS).select(C.valid_bar(timed=False, counted=True).alias("p"), C.valid_bar(ordered=False).alias("f"), C.valid_bar().alias("g"))
    got = [tuple(r) for r in df.collect()]
    assert [r[0] for r in got] == [True, True] + [False] * 9
    assert [r[1] for r in got] == [True, False, True, True, True, True] + [False] * 5
    assert [r[2] for r in got] == [True, False, False, False, True, True] + [False] * 5


def test_archive_marks_come_and_go(spark):
    series = spark.createDataFrame([(1, None), (2, None)], "series long, archived_at string")
    versions = spark.createDataFrame([(10, 1, "completed", True, None), (11, 1, "running", True, None), (12, 1, "completed", True, "old"), (13, 1, "completed", None, None), (20, 2, "completed", True, None)], "id long, series long, status string, published boolean, archived_at string")
    one = series.where("series = 1")
    s, v = upsert.archived(series, versions, one, "series", F.lit("now"))
    assert {r["series"]: r["archived_at"] for r in s.collect()} == {1: "now", 2: None}
    assert {r["id"]: r["archived_at"] for r in v.collect()} == {10: "now", 11: None, 12: "old", 13: None, 20: None}
    assert [r["id"] for r in versions.where(C.usable_version()).orderBy("id").collect()] == [10, 20]
    s, v = upsert.archived(s, v, one, "series", F.lit(None).cast("string"))
    assert s.where("archived_at IS NOT NULL").count() == 0 and v.where("archived_at IS NOT NULL").count() == 0


def test_examples_and_out_of_fold_parts(spark):
    features = spark.createDataFrame([(i, i != 1) for i in range(4)], "at long, ready boolean")
    targets = spark.createDataFrame([(0, True, 2.0, 4.0, 2.0), (1, True, 1.0, 1.0, 1.0), (2, False, 3.0, 0.0, 0.0), (9, True, 1.0, 1.0, 1.0)], "at long, way boolean, up double, down double, normaliser double")
    of = lambda kind, cs: {r["at"]: r["target"] for r in L.examples(features, targets, ["at"], kind, cs, F.col("ready")).collect()}
    assert of("direction", ["way"]) == {0: [1.0], 2: [0.0]}
    assert of("joint", ["up", "down"]) == {0: [1.0, 2.0]}  # no normaliser, no example
    assert of("activity", ["up"]) == {0: [pytest.approx(math.log(3))], 2: [pytest.approx(math.log(4))]}
    with pytest.raises(ValueError):
        of("other", ["up"])
    part = lambda name, ids: spark.createDataFrame([(i, 0.5) for i in ids], f"at long, {name} double")
    both = L.combined_predictions(part("p", [1, 2, 3]), part("j", [2, 3, 4]), spark.createDataFrame([(2, math.log(3)), (3, -1.0), (5, 0.0)], "at long, a double"), ["at"], ["a"])
    assert {r["at"]: r["a"] for r in both.collect()} == {2: pytest.approx(2.0), 3: 1e-12}


def test_trailing_takes_what_there_is(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], p) for p in (-1, 0, 1, 3, 4, 9)] + [([], 2)], "v array<int>, p int")
    assert [r[0] for r in df.select(X.trailing(F.col("v"), F.col("p"))).collect()] == [[1, 2, 3, 4], [1, 2, 3, 4], [4], [2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], []]
