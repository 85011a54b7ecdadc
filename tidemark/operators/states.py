"""States with hysteresis, and what is measured within an occurrence of a state. All by windows.

A state machine whose input either settles the state or keeps it needs no fold: the state is what the last
settling row says. A row settles "up" if it enters, and settles "not up" if up could not outlast it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import activity_terms, log_ratio, ratio, window
from tidemark.operators.orderstats import prefix_median


def _latched(enter: Column, keep: Column, w: Window) -> Column:
    """Whether a state holds that is entered by `enter` and lasts while `keep` does."""
    return F.coalesce(F.last(F.when(enter, True).when(~keep, False), ignorenulls=True).over(w), F.lit(False))


def direction(p: Column, keys: list[str], entry: float = 0.6, hysteresis: float = 0.5) -> Column:
    """up, down or uncertain from the probability of a rise: entered at `entry`, left below
    0.5 + hysteresis * (entry - 0.5); down likewise on the other side."""
    leave = 0.5 + hysteresis * (entry - 0.5)
    w = window(keys)
    up, down = _latched(p >= entry, p >= leave, w), _latched(p <= 1 - entry, p <= 1 - leave, w)
    return F.when(up, "up").when(down, "down").otherwise("uncertain")


def volatility(ratios: dict[str, float], keys: list[str], hysteresis: float = 0.5) -> Column:
    """high or low from ratio columns and their entry thresholds: entered when any ratio exceeds its own, kept while any is
    at least 1 + hysteresis * (threshold - 1). A missing ratio decides nothing."""
    any_of = lambda cs: F.coalesce(F.greatest(*cs, F.lit(False)), F.lit(False))
    enter = any_of([F.coalesce(F.col(c) > t, F.lit(False)) for c, t in ratios.items()])
    keep = any_of([F.coalesce(F.col(c) >= 1 + hysteresis * (t - 1), F.lit(False)) for c, t in ratios.items()])
    return F.when(_latched(enter, keep, window(keys)), "high").otherwise("low")


def space_direction(p: dict[str, Column], keys: list[str], confidence: Column | float, gap: Column | float, hysteresis: Column | float) -> Column:
    """One of three classes: entered with enough probability and lead over the next, kept under relaxed demands."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    confidence, gap, hysteresis = lit(confidence), lit(gap), lit(hysteresis)
    keep_at, keep_gap = 1 / 3 + hysteresis * (confidence - 1 / 3), hysteresis * gap
    w = window(keys)
    out = None
    for name in sorted(p):
        lead = p[name] - F.greatest(*[q for other, q in p.items() if other != name])
        held = _latched((p[name] >= confidence) & (lead >= gap), (p[name] >= keep_at) & (lead >= keep_gap), w)
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise("uncertain")


def space_magnitude(large: Column, keys: list[str], confidence: Column | float, hysteresis: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    confidence, hysteresis = lit(confidence), lit(hysteresis)
    leave = 0.5 + hysteresis * (confidence - 0.5)
    w = window(keys)
    big, small = _latched(large >= confidence, large >= leave, w), _latched(1 - large >= confidence, 1 - large >= leave, w)
    return F.when(big, "large").when(small, "small").otherwise("uncertain")


def occurrences(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Adds occurrence: the running number of unbroken spells of a state."""
    w = window(keys)
    changed = F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(True))
    return rows.withColumn("_new", changed.cast("int")).withColumn("occurrence", F.sum("_new").over(w)).drop("_new")


def trend_deviation(rows: DataFrame, keys: list[str], value: str = "close", to: str = "trend_deviation") -> DataFrame:
    """Adds how far ln(value) lies from the line through the occurrence's earlier rows, in deviations of that line's earlier
    one-step errors; null before four rows. `rows` have an occurrence column."""
    inside = Window.partitionBy(*keys, "occurrence").orderBy("open_time_ms")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumns({"_x": (F.row_number().over(inside) - 1).cast("double"), "_y": F.log(value)})
    at = at.withColumns({"_b": F.regr_slope("_y", "_x").over(past), "_a": F.regr_intercept("_y", "_x").over(past)})
    at = at.withColumn("_e", F.when(F.col("_x") >= 2, F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x")))
    spread = F.coalesce(F.stddev_samp("_e").over(past), F.lit(0.0))
    return at.withColumn("_s", spread).withColumn(to, F.when((F.col("_x") >= 3) & (F.col("_s") > 0), ratio("_e", "_s"))).drop("_x", "_y", "_a", "_b", "_e", "_s")


def blended_scale(rows: DataFrame, keys: list[str], normal: str, observed: str, kappa: float = 20.0, to: str = "effective_scale") -> DataFrame:
    """Adds the normal scale at the occurrence's start, pulled to the median of the scales observed in it so far:
    start^(k / (k + n)) * median^(n / (k + n)) with n positive observations before this row."""
    inside = Window.partitionBy(*keys, "occurrence").orderBy("open_time_ms")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    positive = F.when(F.col(observed) > 0, F.col(observed))
    at = rows.withColumns({"_n": F.count(positive).over(past).cast("double"), "_s": F.first(normal).over(inside), "_p": positive})
    at = prefix_median(at, [*keys, "occurrence"], "open_time_ms", "_p", "_m", 1).drop("_p")
    blend = F.pow("_s", kappa / (kappa + F.col("_n"))) * F.pow(F.coalesce("_m", "_s"), F.col("_n") / (kappa + F.col("_n")))
    return at.withColumn(to, F.when(F.col("_s") > 0, blend)).drop("_n", "_m", "_s")


def future_activity(bars: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Adds the activity of the next `horizon` bars (see indicators.activity), null where they are not all there."""
    w = window(keys)
    ahead = w.rowsBetween(1, horizon)
    before = F.lag("close").over(w)
    rows = bars.withColumns(activity_terms(before)).withColumn("_full", F.count(F.lit(1)).over(ahead) == horizon)
    k = 0.34 / (1.34 + (horizon + 1) / max(1, horizon - 1))
    zero = F.lit(0.0)
    yz = F.coalesce(F.var_samp("_on").over(ahead), zero) + k * F.coalesce(F.var_samp("_oc").over(ahead), zero) + (1 - k) * F.avg("_rs").over(ahead)
    made = {
        "future_tr_mean": F.avg("_tr").over(ahead),
        "future_tr_std": F.coalesce(F.stddev_samp("_tr").over(ahead), zero),
        "future_hl_mean": F.avg("_hl").over(ahead),
        "future_parkinson": F.sqrt(F.avg(F.col("_hl") * F.col("_hl")).over(ahead) / (4 * math.log(2))),
        "future_yang_zhang": F.sqrt(F.greatest(yz, zero)),
    }
    return rows.withColumns({n: F.when(F.col("_full"), c) for n, c in made.items()}).drop("_tr", "_hl", "_on", "_oc", "_rs", "_full")


def normalized_sequence(bars: DataFrame, keys: list[str], lookback: int, to: str = "sequence") -> DataFrame:
    """Adds an array of [ln open, high, low, close against the close before] of the last lookback - 1 rows; null before there are enough."""
    w = window(keys)
    before = F.lag("close").over(w)
    cell = F.array(*[log_ratio(F.col(c), before) for c in ("open", "high", "low", "close")])
    rows = bars.withColumns({"_c": cell, "_n": F.row_number().over(w)})
    frame = w.rowsBetween(-(lookback - 2), 0)
    return rows.withColumn(to, F.when(F.col("_n") >= lookback, F.collect_list("_c").over(frame))).drop("_c", "_n")


def _chain(values: Column, side: int) -> Column:
    """The upper (side 1) or lower (-1) convex chain of the points (i, value), as structs x, y: a fold that keeps a stack.

    A new point takes off the stack's points that lie on or within the line to it. On a convex chain those are the last ones, so
    one filter by neighbours takes them all."""
    points = F.transform(values, lambda v, i: F.struct(i.cast("double").alias("x"), v.cast("double").alias("y")))

    def push(stack: Column, p: Column) -> Column:
        def stands(s: Column, i: Column) -> Column:
            last = F.get(stack, i - 1)
            return (i == 0) | (side * ((s["x"] - last["x"]) * (p["y"] - last["y"]) - (s["y"] - last["y"]) * (p["x"] - last["x"])) < 0)

        return F.array_append(F.filter(stack, stands), p)

    return F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), push)


def _below(chain: Column) -> Column:
    """The area between a chain and the axis."""

    def add(a: Column, p: Column) -> Column:
        step = F.coalesce((p["x"] - a["last"]["x"]) * (p["y"] + a["last"]["y"]) / 2, F.lit(0.0))
        return F.struct((a["area"] + step).alias("area"), p.alias("last"))

    return F.aggregate(chain, F.struct(F.lit(0.0).alias("area"), F.lit(None).cast("struct<x:double,y:double>").alias("last")), add)["area"]


def hull_area(lows: Column, highs: Column) -> Column:
    """Area of the convex hull of the points (i, low) and (i, high): what lies below the upper chain less what lies below the lower."""
    return _below(_chain(highs, 1)) - _below(_chain(lows, -1))


def geometry(bars: DataFrame, keys: list[str], before: int, after: int, area: str = "area", slope: str = "slope") -> DataFrame:
    """Adds hull area of lows and highs and the least-squares slope of closes over the rows from `before` back to `after` ahead;
    null where not all of them are there."""
    w = window(keys)
    frame = w.rowsBetween(-before, after)
    rows = bars.withColumns({"_i": F.row_number().over(w).cast("double"), "_n": F.count(F.lit(1)).over(frame)})
    rows = rows.withColumns({"_lo": F.collect_list("low").over(frame), "_hi": F.collect_list("high").over(frame), "_s": F.regr_slope("close", "_i").over(frame)})
    whole = F.col("_n") == before + after + 1
    return rows.withColumns({area: F.when(whole, hull_area(F.col("_lo"), F.col("_hi"))), slope: F.when(whole, F.col("_s"))}).drop("_i", "_n", "_lo", "_hi", "_s")
