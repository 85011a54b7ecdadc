"""Search of state rules: every combination of thresholds is scored by how much its states tell about what came after.

The states of all rules are window columns over the same partitions, so rows are shuffled once, whatever the number of rules; what is exploded by
rule is counted before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import window
from tidemark.operators.states import direction, space_direction, space_magnitude, volatility

Rule = dict[str, float | str]
#: The thresholds that are tried.
BOUNDARIES = (0.1, 0.2, 0.3, 0.4)
CONFIDENCES = (0.45, 0.55, 0.65, 0.75)
GAPS = (0.05, 0.15, 0.25)
HYSTERESES = (0.0, 0.5, 1.0)
SIZE_QUANTILES = (0.35, 0.5, 0.65)
SIZE_CONFIDENCES = (0.55, 0.65, 0.75, 0.85)
ENTRIES = (0.55, 0.6, 0.65, 0.7, 0.75)
THRESHOLDS = (1.1, 1.25, 1.5, 2.0)
#: A rule must be certain on so many rows, and on one in so many, to be chosen.
LEAST, ONE_IN = 5, 50


def _joint(rows: DataFrame, group: list[str], rules: list[Rule], state: Callable[[Rule], Column], truth: Column) -> DataFrame:
    """(group, the rules' names, state, truth, n, t): how many rows a rule had in a state while `truth` came, and how many of them changed the state."""
    at = rows.withColumns({f"_s{i}": state(r) for i, r in enumerate(rules)})
    turned = lambda i: F.coalesce(F.lag(f"_s{i}").over(window(group)) != F.col(f"_s{i}"), F.lit(False))
    at = at.withColumns({f"_t{i}": turned(i) for i in range(len(rules))})
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.items()], F.col(f"_s{i}").alias("state"), F.col(f"_t{i}").alias("turned")) for i, r in enumerate(rules)])
    exploded = at.select(*group, truth.alias("truth"), F.inline(each))
    return exploded.groupBy(*group, *rules[0], "state", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_if("turned").alias("t"))


def _scored(rows: DataFrame, keys: list[str], group: list[str], rules: list[Rule], state: Callable[[Rule], Column], truth: Column) -> DataFrame:
    """Scores by mutual information; n, hits (state and outcome alike) and the choice besides. group: keys, and boundary where there is one."""
    names, bounds = list(rules[0]), [c for c in group if c not in keys]
    whole = Window.partitionBy(*group, *names)
    joint = _joint(rows, group, rules, state, truth)
    joint = joint.withColumns({"all": F.sum("n").over(whole), "a": F.sum("n").over(Window.partitionBy(*group, *names, "state")), "b": F.sum("n").over(Window.partitionBy(*group, *names, "truth"))})
    p = F.col("n") / F.col("all")
    told, ha, hb = F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))), F.sum(-p * F.log(F.col("a") / F.col("all"))), F.sum(-p * F.log(F.col("b") / F.col("all")))
    score = F.when(ha * hb > 0, told / F.nullif(F.sqrt(ha * hb), F.lit(0.0))).otherwise(0.0)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    found = joint.groupBy(*group, *names).agg(score.alias("nmi"), F.sum("t").alias("switches"), total(F.col("state") != "uncertain").alias("support"), total(F.col("state") == F.col("truth")).alias("hits"), F.any_value("all").alias("n"))
    enough = F.col("support") >= F.greatest(F.lit(LEAST), F.floor(F.col("n") / ONE_IN))
    simple = sum((F.col(n) for n in names if n != "hysteresis"), F.lit(0.0))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(enough.desc(), F.round("nmi", 12).desc(), "switches", simple, *bounds, *names)
    return found.withColumn("chosen", enough & (F.row_number().over(order) == 1))


def direction_rules(rows: DataFrame, keys: list[str], confidences: tuple[float, ...] = CONFIDENCES, gaps: tuple[float, ...] = GAPS, hystereses: tuple[float, ...] = HYSTERESES) -> DataFrame:
    """(keys, boundary, confidence, gap, hysteresis, nmi, switches, support, chosen) of every rule.

    rows: (keys, boundary, open_time_ms, up, balanced, down, lean): the forecast shares of the three directions when moves that lean by more than the boundary
    have one, and the lean that came, (up - down) / (up + down), null (balanced) where nothing moved. nmi is the mutual information of states and what came
    over the geometric mean of their entropies, 0 if either is certain; support the rows whose state is not uncertain. Chosen of each key is, among rules
    with support enough, the largest nmi (to 1e-12), then the fewest switches, then the smallest confidence and gap, then the first in order."""
    came = F.when(F.col("lean") > F.col("boundary"), "up").when(F.col("lean") < -F.col("boundary"), "down").otherwise("balanced")
    shares = {k: F.col(k) for k in ("up", "balanced", "down")}
    rules = [{"confidence": c, "gap": g, "hysteresis": h} for c in confidences for g in gaps for h in hystereses]
    group = [*keys, "boundary"]
    return _scored(rows, keys, group, rules, lambda r: space_direction(shares, group, r["confidence"], r["gap"], r["hysteresis"]), came).drop("n", "hits")


def magnitude_rules(rows: DataFrame, keys: list[str], confidences: tuple[float, ...] = SIZE_CONFIDENCES, hystereses: tuple[float, ...] = HYSTERESES) -> DataFrame:
    """The same for sizes, without gap. rows: (keys, boundary, open_time_ms, large, size): the forecast share of sizes of the boundary or more, and the size that came."""
    came = F.when(F.col("size") >= F.col("boundary"), "large").otherwise("small")
    rules = [{"confidence": c, "hysteresis": h} for c in confidences for h in hystereses]
    group = [*keys, "boundary"]
    return _scored(rows, keys, group, rules, lambda r: space_magnitude(F.col("large"), group, r["confidence"], r["hysteresis"]), came).drop("n", "hits")


def size_boundaries(rows: DataFrame, keys: list[str], size: str, quantiles: tuple[float, ...] = SIZE_QUANTILES) -> DataFrame:
    """(keys, boundary): quantiles of each key's sizes above 0, interpolated."""
    some = rows.where(F.col(size) > 0).groupBy(*keys).agg(F.percentile(size, F.array(*map(F.lit, quantiles))).alias("_q"))
    return some.select(*keys, F.explode("_q").alias("boundary"))


def endpoint_rules(rows: DataFrame, keys: list[str], entries: tuple[float, ...] = ENTRIES, hystereses: tuple[float, ...] = HYSTERESES) -> DataFrame:
    """(keys, entry, hysteresis, nmi, switches, support, coverage, hit_rate, chosen) of each rule of `states.direction`.

    rows: (keys, open_time_ms, p, rose): the forecast share of rises and whether the price rose; rows that do not tell are left out. coverage is the part of rows whose state is
    not uncertain, hit_rate the part of those that came true, 0 if there are none. The choice is that of `direction_rules`, with the smallest entry."""
    rules = [{"entry": e, "hysteresis": h} for e in entries for h in hystereses]
    came = F.when(F.col("rose"), "up").otherwise("down")
    found = _scored(rows.where("rose IS NOT NULL"), keys, list(keys), rules, lambda r: direction(F.col("p"), keys, r["entry"], r["hysteresis"]), came)
    hit = F.when(F.col("support") > 0, F.col("hits") / F.nullif("support", F.lit(0))).otherwise(0.0)
    return found.select(*keys, "entry", "hysteresis", "nmi", "switches", "support", (F.col("support") / F.col("n")).alias("coverage"), hit.alias("hit_rate"), "chosen")


def ratio_choices(groups: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Every choice of one ratio from each of some of the groups: by the groups taken, counted in binary with the first lowest, then by ratios, the last fastest."""
    out: list[tuple[str, ...]] = []
    for mask in range(1, 1 << len(groups)):
        out += product(*[g for i, g in enumerate(groups) if mask >> i & 1])
    return out


def volatility_rules(rows: DataFrame, keys: list[str], groups: list[tuple[str, ...]], thresholds: tuple[float, ...] = THRESHOLDS, hystereses: tuple[float, ...] = HYSTERESES) -> DataFrame:
    """(keys, threshold, place, ratios, hysteresis, balanced_accuracy, false_exits, exit_delay, switches, chosen) of each rule of `states.volatility`.

    rows: (keys, open_time_ms, the ratios, high): whether what came was high; rows that do not tell are left out. A rule takes ratios of `ratio_choices` (place
    is the choice's number, ratios its names joined by +), all at one threshold. false_exits are changes to low while high came, exit_delay the rows that
    are high while low came. Chosen of each key is the largest balanced accuracy (to 1e-12), then the fewest false exits, then the least delay, then the first by
    place, threshold and hysteresis. Rows are copied once a threshold."""
    choices = ratio_choices(groups)
    rules = [{"place": i, "ratios": "+".join(c), "hysteresis": h} for i, c in enumerate(choices) for h in hystereses]
    group = [*keys, "threshold"]
    told = rows.where("high IS NOT NULL").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    state = lambda r: volatility({c: F.col("threshold") for c in choices[r["place"]]}, group, r["hysteresis"])
    joint = _joint(told, group, rules, state, F.when(F.col("high"), "high").otherwise("low"))
    cell = lambda s, t, c="n": F.sum(F.when((F.col("state") == s) & (F.col("truth") == t), F.col(c)).otherwise(0))
    part = lambda a, b: F.when(a + b > 0, a / F.nullif(a + b, F.lit(0))).otherwise(0.0)
    accuracy = (part(cell("high", "high"), cell("low", "high")) + part(cell("low", "low"), cell("high", "low"))) / 2
    found = joint.groupBy(*group, "place", "ratios", "hysteresis").agg(accuracy.alias("balanced_accuracy"), cell("low", "high", "t").alias("false_exits"), cell("high", "low").alias("exit_delay"), F.sum("t").alias("switches"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.round("balanced_accuracy", 12).desc(), "false_exits", "exit_delay", "place", "threshold", "hysteresis")
    return found.withColumn("chosen", F.row_number().over(order) == 1)
