"""Portfolio simulations: those that windows can express, and grouped folds for those with feedback."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import buy_quantity
from tidemark.operators.indicators import window
from tidemark.sources.bars import utc_date


def month_change(keys: list[str]) -> Column:
    """Whether a bar is the first of a new UTC month; the first bar of all is none."""
    month = F.date_format(utc_date("open_time_ms"), "yyyy-MM")
    return F.coalesce(month != F.lag(month).over(window(keys)), F.lit(False))


def ghost_dca(bars: DataFrame, keys: list[str], initial: float, monthly: float, fee: float, spread: float, price: str = "close", evaluation_start_ms: int | None = None) -> DataFrame:
    """Adds quantity, nav and injected: all cash at the first bar, then `monthly` at the first bar of each month;
    flows count from the evaluation's start, not at it, and rows before it are left out."""
    w = window(keys)
    rows = bars.withColumns({"_i": F.row_number().over(w), "_m": month_change(keys)})
    cash = F.when(F.col("_i") == 1, F.lit(initial)).when(F.col("_m"), F.lit(monthly)).otherwise(0.0)
    since = F.lit(evaluation_start_ms) if evaluation_start_ms is not None else F.min("open_time_ms").over(Window.partitionBy(*(keys or [F.lit(0)])))
    flow = F.when(F.col("_m") & (F.col("open_time_ms") > since), F.lit(monthly)).otherwise(0.0)
    rows = rows.withColumns({"_buy": buy_quantity(cash, F.col(price), fee, spread), "_flow": flow, "_since": since})
    rows = rows.withColumns({"quantity": F.sum("_buy").over(w), "injected": F.sum("_flow").over(w)}).withColumn("nav", F.col("quantity") * F.col("close"))
    return rows.where("open_time_ms >= _since").drop("_i", "_m", "_buy", "_flow", "_since")


def rule_targets(bars: DataFrame, keys: list[str], every: int = 5) -> DataFrame:
    """Adds the targets of simple rules: always in, on odd or even days, and in and out every so many bars."""
    day = F.dayofmonth(utc_date("open_time_ms"))
    at = F.row_number().over(window(keys)) - 1
    bit = lambda c: c.cast("int").cast("double")
    return bars.withColumns({"always": F.lit(1.0), "odd_day": bit(day % 2 == 1), "even_day": bit(day % 2 == 0), "toggle": bit(F.floor(at / every) % 2 == 0)})


def window_scores(navs: DataFrame, series: str, benchmark: str, win: str) -> DataFrame:
    """Return over the benchmark's less 1.5 times the excess drawdown, per window; -99999 for a drawdown of 0.88."""
    w = Window.partitionBy(series, win).orderBy("open_time_ms")
    rows = navs.withColumn("_peak", F.max("nav").over(w))
    s = rows.groupBy(series, win).agg((F.max_by("nav", "open_time_ms") / F.min_by("nav", "open_time_ms") - 1).alias("roi"), F.max((F.col("_peak") - F.col("nav")) / F.col("_peak")).alias("dd"))
    b = s.where(F.col(series) == benchmark).select(win, F.col("roi").alias("b_roi"), F.col("dd").alias("b_dd"))
    score = F.when(F.col("dd") >= 0.88, F.lit(-99999.0)).otherwise(F.col("roi") - F.col("b_roi") - 1.5 * F.greatest(F.col("dd") - F.col("b_dd"), F.lit(0.0)))
    return s.join(b, win).select(series, win, score.alias("score"))


@dataclass(frozen=True)
class ReplaySpec:
    """How targets are followed: at the next bar's open, this bar's open or this bar's close; open_buy_close_sell ignores them,
    buys all at each open and sells all at the close."""

    initial: float = 1000.0
    monthly: float = 0.0
    fee: float = 0.0
    spread: float = 0.0
    mode: str = "close_next_open"
    min_trade: float = 0.0


REPLAY = "open_time_ms long, nav double, cash double, quantity double, exposure double, trades int, injected double"


def _replay(open_: np.ndarray, close: np.ndarray, target: np.ndarray, fresh: np.ndarray, spec: ReplaySpec) -> dict[str, np.ndarray]:
    cash, quantity, trades, injected, pending = spec.initial, 0.0, 0, 0.0, np.nan
    out = {k: np.zeros(len(close)) for k in ("nav", "cash", "quantity", "exposure", "trades", "injected")}

    def rebalance(price: float, weight: float) -> None:
        nonlocal cash, quantity, trades
        equity = cash + quantity * price
        gap = min(max(weight, 0.0), 1.0) * equity - quantity * price
        if abs(gap) <= max(spec.min_trade, 1e-12 * max(equity, 1.0)):
            return
        if gap > 0:
            spend = min(gap, cash)
            if spend <= 0:
                return
            quantity += spend / (price * (1 + spec.spread) * (1 + spec.fee))
            cash -= spend
        else:
            sold = min(quantity, -gap / price)
            quantity -= sold
            cash += sold * price * (1 - spec.spread) * (1 - spec.fee)
        trades += 1

    for i in range(len(close)):
        if fresh[i]:
            cash += spec.monthly
            injected += spec.monthly
        if spec.mode == "close_next_open" and not np.isnan(pending):
            rebalance(open_[i], pending)
        if spec.mode == "same_open":
            rebalance(open_[i], target[i])
        if spec.mode == "same_close":
            rebalance(close[i], target[i])
        if spec.mode == "open_buy_close_sell":
            rebalance(open_[i], 1.0)
            rebalance(close[i], 0.0)
        pending = target[i]
        nav = cash + quantity * close[i]
        for k, v in (("nav", nav), ("cash", cash), ("quantity", quantity), ("exposure", quantity * close[i] / nav if nav > 0 else 0.0), ("trades", trades), ("injected", injected)):
            out[k][i] = v
    return out


def replay_exposure(bars: DataFrame, keys: list[str], spec: ReplaySpec = ReplaySpec(), target: str = "target") -> DataFrame:
    """NAV of each run that follows its column of target weights: one grouped fold per run.

    Orders of mode close_next_open execute at the next bar's open, so a target never acts on its own bar."""
    rows = bars.withColumn("_fresh", month_change(keys)).select(*keys, "open_time_ms", "open", "close", target, "_fresh")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time_ms", kind="stable")
        got = _replay(pdf["open"].to_numpy(), pdf["close"].to_numpy(), pdf[target].to_numpy(float), pdf["_fresh"].to_numpy(bool), spec)
        out = pdf[[*keys, "open_time_ms"]].assign(**got)
        return out.astype({"trades": "int32"})

    kinds = dict(bars.dtypes)
    return rows.groupBy(*keys).applyInPandas(fold, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], REPLAY]))


def shuffled_targets(bars: DataFrame, keys: list[str], seed: int, target: str = "target") -> DataFrame:
    """Control paths: the targets of each run in a seeded random order, at the original times."""
    from tidemark.functions.scalar import keyed_uniform

    w = window(keys)
    at = bars.withColumn("_i", F.row_number().over(w))
    shuffled = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(keyed_uniform(F.lit(seed), F.col("open_time_ms")), "open_time_ms")
    moved = bars.withColumn("_i", F.row_number().over(shuffled)).select(*keys, "_i", F.col(target).alias("_moved"))
    return at.join(moved, [*keys, "_i"]).withColumn(target, F.col("_moved")).drop("_i", "_moved")


def released_lots(lots: DataFrame, keys: list[str], target: Column, order: list[str], amount: str = "amount", eligible: Column | None = None) -> DataFrame:
    """Adds released and kept: the key's target taken from its eligible lots in order, the last one split."""
    can = F.coalesce(eligible if eligible is not None else F.lit(True), F.lit(False))
    size = F.when(can, F.greatest(F.col(amount), F.lit(0.0))).otherwise(0.0)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lots.withColumn("_size", size).withColumn("_before", F.sum("_size").over(w) - F.col("_size"))
    released = F.greatest(F.least(target - F.col("_before"), F.col("_size")), F.lit(0.0))
    return rows.withColumn("released", released).withColumn("kept", F.col(amount) - F.col("released")).drop("_size", "_before")


def with_region_parameters(rows: DataFrame, packs: DataFrame, region: str = "region", first: str | None = None) -> DataFrame:
    """Rows with the parameters of their region; a region without any gets those of the key `first`. packs has one row a region,
    as many as thresholds cut."""
    names = [c for c in packs.columns if c != region]
    other = packs.where(F.col(region) == first).select(*[F.col(c).alias(f"_first_{c}") for c in names]) if first is not None else None
    out = rows.join(F.broadcast(packs), region, "left")
    if other is None:
        return out
    out = out.crossJoin(F.broadcast(other))  # one row
    return out.withColumns({c: F.coalesce(c, f"_first_{c}") for c in names}).drop(*[f"_first_{c}" for c in names])
