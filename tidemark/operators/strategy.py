"""The sigmoid strategy: indicators by windows, then one grouped fold per run.

All that depends on prices alone (signal terms, regime, multipliers, filter signals) is a column before the
fold, so the fold carries only what feeds back: cash, holdings, pending orders. A run is a row of
parameters; runs are groups of their own and spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import indicators, long_term_filter, market_regime, window
from tidemark.operators.simulate import month_change

#: Lowest, highest and starting value of each parameter.
PARAMETERS = {
    "micro_reserve_pct": (0.10, 0.45, 0.25),
    "beta": (0.20, 8.00, 2.00),
    "gamma": (0.00, 5.00, 1.00),
    "w_mean": (-3.00, 3.00, 1.00),
    "w_momentum": (-3.00, 3.00, -0.50),
    "w_breakout": (-3.00, 3.00, 0.75),
    "dust_usd": (5.00, 25.00, 10.10),
    "rebalance_threshold": (0.00, 1.00, 0.00),
    "force_full_threshold": (0.00, 1.00, 1.00),
    "force_empty_threshold": (0.00, 1.00, 0.00),
    "wedge_delta_threshold": (0.01, 0.15, 0.04),
    "wedge_vol_ratio_threshold": (1.10, 2.50, 1.60),
    "macro_bear_multiplier": (1.00, 2.50, 1.40),
    "macro_bull_multiplier": (0.20, 1.00, 0.60),
    "extra_deploy_pct": (0.00, 0.60, 0.20),
    "soft_release_months": (3, 36, 12),
    "soft_release_pct": (0.00, 0.25, 0.08),
    "hard_release_max_pct": (0.00, 0.50, 0.15),
}
#: Bars that a decision needs.
HISTORY = 113
PATH = (
    "open_time_ms long, nav double, cash double, quantity double, exposure double, practical_nav double, practical_exposure double, "
    "target double, trades int, costs double, risk_off boolean, injected double"
)
INPUTS = ("open_time_ms", "open", "close", "_ready", "_mean", "_mom", "_brk", "_beta", "_vol", "_quiet", "_regime", "_deep", "_month", "_fresh", "_signal")


@dataclass(frozen=True)
class Spec:
    """What all runs share; filter_months of 0 leaves the filter out."""

    initial: float = 10_000.0
    monthly: float = 0.0
    macro_monthly: float = 100.0
    fee: float = 0.0
    spread: float = 0.0
    min_trade: float = 0.0
    mode: str = "close_next_open"
    floating_only: bool = False
    filter_months: int = 0
    evaluation_start_ms: int | None = None


def clamped(runs: DataFrame) -> DataFrame:
    """Parameters within their bounds, whole months, and the bear multiplier no less than the bull's; missing ones at their start."""
    out = runs
    for name, (low, high, start) in PARAMETERS.items():
        c = F.coalesce(F.col(name).cast("double"), F.lit(float(start))) if name in runs.columns else F.lit(float(start))
        out = out.withColumn(name, F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low))))
    return out.withColumns({"soft_release_months": F.floor("soft_release_months").cast("double"), "macro_bear_multiplier": F.greatest("macro_bear_multiplier", "macro_bull_multiplier")})


def is_legal() -> Column:
    """Whether the parameters of a row fit together."""
    return (F.col("dust_usd") > 0) & (F.col("macro_bear_multiplier") >= F.col("macro_bull_multiplier")) & (F.col("force_full_threshold") >= F.col("force_empty_threshold"))


def signal_inputs(bars: DataFrame, keys: list[str], filter_months: int = 0) -> DataFrame:
    """The columns of INPUTS for each bar."""
    rows = market_regime(indicators(bars, keys)).withColumn("_fresh", month_change(keys))
    sigma = F.greatest(F.col("sigma"), F.lit(0.001))
    rows = rows.withColumns(
        {
            "_ready": F.col("n") >= HISTORY,
            "_mean": (F.col("close") / F.col("ema_fast") - 1) / sigma,
            "_mom": F.coalesce("momentum", F.lit(0.0)),
            "_brk": F.col("depth"),
            "_beta": F.col("beta_multiplier"),
            "_vol": F.col("volatility_ratio"),
            "_quiet": F.col("is_quiet"),
            "_regime": F.col("regime"),
            "_deep": F.col("depth") < -0.2,
            "_month": F.date_format(F.timestamp_millis("open_time_ms").cast("timestamp_ntz"), "yyyyMM").cast("int"),
        }
    )
    signal = F.lit(0)
    if filter_months:
        rows = long_term_filter(rows, keys, filter_months)
        w = window(keys)
        # what becomes known after this bar is the next bar's state
        risk = lambda c: F.coalesce(c == -1, F.lit(False))
        later, now = risk(F.lead("filter_state").over(w)), risk(F.col("filter_state"))
        signal = F.when(later & ~now, 1).when(~later & now & F.lead("open_time_ms").over(w).isNotNull(), -1).otherwise(0)
    return rows.withColumn("_signal", signal).select(*keys, *INPUTS)


class Account:
    """Cash, a free holding, and a stack that is sold only once released."""

    def __init__(self, cash: float):
        self.cash, self.free, self.stack = cash, 0.0, 0.0

    def equity(self, price: float) -> float:
        return self.cash + (self.free + self.stack) * price

    def weight(self, price: float, quantity: float | None = None) -> float:
        e = self.equity(price)
        q = self.free + self.stack if quantity is None else quantity
        return min(max(q * price / e, 0.0), 1.0) if e > 0 else 0.0

    def buy(self, amount: float, price: float, s: Spec, to_stack: bool = False) -> tuple[int, float]:
        amount = min(amount, self.cash)
        if amount <= s.min_trade or amount <= 0:
            return 0, 0.0
        fill = price * (1 + s.spread)
        quantity = amount / (fill * (1 + s.fee))
        self.cash -= amount
        self.stack, self.free = (self.stack + quantity, self.free) if to_stack else (self.stack, self.free + quantity)
        return 1, quantity * (fill * s.fee + fill - price)

    def sell(self, quantity: float, price: float, s: Spec, whole: bool = False, least: bool = True) -> tuple[int, float]:
        """Sells from the free holding, with `whole` from the stack too."""
        quantity = min(quantity, self.free + (self.stack if whole else 0.0))
        if quantity <= 0 or (least and quantity * price <= s.min_trade):
            return 0, 0.0
        fill = price * (1 - s.spread)
        self.cash += quantity * fill * (1 - s.fee)
        from_free = min(quantity, self.free)
        self.free -= from_free
        self.stack -= quantity - from_free
        return 1, quantity * (fill * s.fee + price - fill)

    def follow(self, target: float, price: float, s: Spec) -> tuple[int, float]:
        e = self.equity(price)
        gap = min(max(target, 0.0), 1.0) * e - (self.free + self.stack) * price
        if e <= 0 or abs(gap) <= s.min_trade:
            return 0, 0.0
        return self.buy(gap, price, s) if gap > 0 else self.sell(-gap / price, price, s, whole=True)

    def execute(self, order: dict, price: float, s: Spec) -> tuple[int, float]:
        """Release, then the monthly purchase, then the balancing trade."""
        moved = min(order["release"], self.stack)
        self.stack, self.free = self.stack - moved, self.free + moved
        n, cost = self.buy(order["macro"], price, s, to_stack=True) if order["macro"] > 0 else (0, 0.0)
        if order["micro"] > 0:
            m, c = self.buy(order["micro"], price, s)
        elif order["sell"] > 0:
            m, c = self.sell(order["sell"], price, s)
        else:
            m, c = 0, 0.0
        return n + m, cost + c


def _cents(x: float) -> float:
    return float(np.sign(x) * np.floor(abs(x) * 100 + 0.5) / 100)


def _decide(row: dict, p: dict, account: Account, last_month: int, s: Spec) -> tuple[dict, float, int]:
    """Order, target weight of the free holding and month of the last monthly decision, at a bar's close."""
    none = {"release": 0.0, "macro": 0.0, "micro": 0.0, "sell": 0.0}
    price = row["close"]
    equity = account.equity(price)
    if not row["_ready"] or equity <= 0:
        return none, 0.0, last_month
    spendable = max(0.0, account.cash - equity * p["micro_reserve_pct"])
    weight = account.weight(price, account.free)
    signal = p["w_mean"] * row["_mean"] + p["w_momentum"] * row["_mom"] + p["w_breakout"] * row["_brk"]
    x = max(0.01, p["beta"] * row["_beta"]) * signal + p["gamma"] * (weight - 0.5)
    target = float(1 / (1 + np.exp(min(max(x, -700.0), 700.0))))
    wanted, dust = (target - weight) * equity, p["dust_usd"]
    forced = False
    if abs(wanted) < dust:
        forced = wanted != 0 and not row["_quiet"] and (abs(target - weight) >= p["wedge_delta_threshold"] or row["_vol"] >= p["wedge_vol_ratio_threshold"])
        wanted = float(np.sign(wanted)) * dust if forced else 0.0
    if wanted > 0:
        wanted = min(wanted, spendable)
    wanted = _cents(wanted) if abs(wanted) >= dust or forced else 0.0
    order = none | {"micro": max(wanted, 0.0), "sell": max(-wanted, 0.0) / price}
    if s.floating_only:
        return order, target, last_month
    if row["_month"] != last_month:
        last_month = row["_month"]
        times = {"bull": min(max(p["macro_bull_multiplier"], 0.2), 1.0), "bear": min(max(p["macro_bear_multiplier"], 1.0), 2.5), "shock": 1.8 if row["_deep"] else 1.0}.get(row["_regime"], 1.0)
        budget = s.macro_monthly * times + spendable * min(max(p["extra_deploy_pct"], 0.0), 0.6)
        amount = _cents(min(budget, spendable))
        order["macro"] = amount if amount >= dust else 0.0
    if order["sell"] > 0:
        soft = min(account.stack * p["soft_release_pct"], order["sell"]) if row["_regime"] in ("bull", "shock") else 0.0
        short = order["sell"] - account.free - soft
        order["release"] = soft + (min(account.stack * p["hard_release_max_pct"], short) if short > 0 else 0.0)
    return order, target, last_month


def _gated(order: dict, target: float, p: dict, account: Account, price: float) -> tuple[dict, float]:
    """Order and total target after the thresholds that force all or nothing and the one that skips small changes."""
    equity = account.equity(price)
    fixed = account.weight(price, account.stack)
    total = min(max(fixed + min(max(target, 0.0), 1.0), 0.0), 1.0)
    to = 1.0 if p["force_full_threshold"] < 1 and total >= p["force_full_threshold"] else 0.0 if p["force_empty_threshold"] > 0 and total <= p["force_empty_threshold"] else None
    if to is not None and equity > 0:
        held, dust = account.free + account.stack, p["dust_usd"]
        gap = to * equity - held * price
        amount = min(gap, account.cash)
        sold = min(-gap / price, held) if gap < -dust else 0.0
        order = {"release": min(account.stack, max(sold - account.free, 0.0)), "macro": 0.0, "micro": amount if gap > dust and amount > dust else 0.0, "sell": sold if sold * price > dust else 0.0}
        total, target = to, min(max(to - fixed, 0.0), 1.0)
    if p["rebalance_threshold"] > 0 and equity > 0 and abs(target - account.weight(price, account.free)) < p["rebalance_threshold"]:
        order = order | {"micro": 0.0, "sell": 0.0, "release": 0.0}
    return order, total


def _trades(order: dict) -> bool:
    return any(v > 0 for v in order.values())


def _fold(rows: list[dict], p: dict, s: Spec) -> list[tuple]:
    """Per bar: contribute, execute what the bar before decided, decide, record. `real` is the account after the
    long-term filter, `plain` the one that the decisions see."""
    plain, real = Account(s.initial), Account(s.initial)
    pending, signal, last_month, injected = None, 0, 0, 0.0
    risk_off = apart = False
    out = []

    def act(order: dict, signal: int, price: float, contributed: bool) -> tuple[int, float]:
        nonlocal risk_off, apart
        plain.execute(order, price, s)
        weight = plain.weight(price)
        if signal:
            risk_off, apart = signal > 0, True
            return real.sell(real.free + real.stack, price, s, whole=True, least=False) if risk_off else real.follow(weight, price, s)
        if risk_off:
            return 0, 0.0
        if apart:
            return real.follow(weight, price, s) if contributed or _trades(order) else (0, 0.0)
        return real.execute(order, price, s)

    for row in rows:
        contributed = bool(row["_fresh"]) and s.monthly > 0
        if contributed:
            plain.cash, real.cash = plain.cash + s.monthly, real.cash + s.monthly
            if s.evaluation_start_ms is None or row["open_time_ms"] > s.evaluation_start_ms:
                injected += s.monthly
        trades, cost = 0, 0.0
        if pending is not None and s.mode == "close_next_open":
            trades, cost = act(pending, signal, row["open"], contributed)
        order, target, last_month = _decide(row, p, plain, last_month, s)
        order, total = _gated(order, target, p, plain, row["close"])
        pending, signal = order, int(row["_signal"])
        if s.mode != "close_next_open":
            trades, cost = act(order, signal, row["close"], contributed)
        price = row["close"]
        if s.evaluation_start_ms is None or row["open_time_ms"] >= s.evaluation_start_ms:
            out.append((row["open_time_ms"], real.equity(price), real.cash, real.free + real.stack, real.weight(price), plain.equity(price), plain.weight(price), total, trades, cost, risk_off, injected))
    return out


def _runs_over(inputs: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each run's bars; runs without the bars' key get every series."""
    shared = [k for k in keys if k in runs.columns]
    return inputs.join(runs, shared) if shared else inputs.crossJoin(runs)  # a run is a copy of the series


def backtest(bars: DataFrame, keys: list[str], runs: DataFrame, spec: Spec = Spec(), run_id: str = "run_id") -> DataFrame:
    """(keys, run_id, path): the path of each run (run_id and parameters, see PARAMETERS) over each series.

    Orders of mode close_next_open execute at the next bar's open; any other mode at the deciding bar's close.
    Bars without a price above 0 are left out; illegal runs fail no job but give no rows.
    """
    legal = clamped(runs).where(is_legal())
    inputs = signal_inputs(bars.where("close > 0 AND open > 0"), keys, spec.filter_months)
    rows = _runs_over(inputs, legal, keys)
    kinds = dict(rows.dtypes)
    group = [*keys, run_id]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time_ms", kind="stable")
        p = {k: float(pdf[k].iloc[0]) for k in PARAMETERS}
        path = pd.DataFrame(_fold(pdf[list(INPUTS)].to_dict("records"), p, spec), columns=[c.split()[0] for c in PATH.split(", ")])
        for k in group[::-1]:
            path.insert(0, k, pdf[k].iloc[0])
        return path.astype({"trades": "int32"})

    return rows.groupBy(*group).applyInPandas(fold, ", ".join(f"`{k}` {kinds[k]}" for k in group) + ", " + PATH)


def position(bars: DataFrame, keys: list[str], runs: DataFrame, start_ms: int, initial: float, monthly: float = 0.0, run_id: str = "run_id") -> DataFrame:
    """(keys, run_id, open_time_ms, nav, target, exposure, invested): each bar's close brings the holding to the model's
    target, without costs, from start_ms on."""
    rows = _runs_over(signal_inputs(bars.where("close > 0"), keys), clamped(runs), keys)
    kinds = dict(rows.dtypes)
    group = [*keys, run_id]
    spec = Spec(initial=initial, floating_only=True)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["open_time_ms"] >= start_ms].sort_values("open_time_ms", kind="stable")
        account, invested, out = Account(initial), initial, []
        for i, row in enumerate(pdf[list(INPUTS)].to_dict("records")):
            if i and row["_fresh"] and monthly > 0:
                account.cash, invested = account.cash + monthly, invested + monthly
            p = {k: float(pdf[k].iloc[0]) for k in PARAMETERS} if not i else p
            price = row["close"]
            target = _decide(row, p, account, 0, spec)[1] if row["_ready"] else account.weight(price)
            account.follow(target, price, spec)
            out.append((row["open_time_ms"], account.equity(price), target, account.weight(price), invested))
        path = pd.DataFrame(out, columns=["open_time_ms", "nav", "target", "exposure", "invested"])
        for k in group[::-1]:
            path.insert(0, k, pdf[k].iloc[0] if len(pdf) else None)
        return path

    return rows.groupBy(*group).applyInPandas(fold, ", ".join(f"`{k}` {kinds[k]}" for k in group) + ", open_time_ms long, nav double, target double, exposure double, invested double")


#: Label, days and weight of the windows that a candidate is judged on; no days means the whole series.
WINDOWS = (("6m", 183, 0.10), ("2y", 730, 0.20), ("5y", 1825, 0.30), ("10y", None, 0.40))


def crucible_windows(bars: DataFrame, keys: list[str], warmup_days: int = 1200) -> DataFrame:
    """Adds win, weight and evaluation_ms to each window's copy of the bars: its days and a warm-up before them."""
    day = 86_400_000
    latest = F.max("open_time_ms").over(Window.partitionBy(*(keys or [F.lit(0)])))
    first = F.min("open_time_ms").over(Window.partitionBy(*(keys or [F.lit(0)])))
    specs = F.array(*[F.struct(F.lit(n).alias("win"), F.lit(w).alias("weight"), F.lit(d).cast("long").alias("days")) for n, d, w in WINDOWS])
    rows = bars.withColumns({"_latest": latest, "_first": first}).withColumn("_w", F.explode(specs))
    start = F.when(F.col("_w.days").isNull(), F.col("_first")).otherwise(F.col("_latest") - F.col("_w.days") * day)
    rows = rows.withColumns({"win": F.col("_w.win"), "weight": F.col("_w.weight"), "_start": start}).where(F.col("_w.days").isNull() | (F.col("open_time_ms") >= F.col("_start") - warmup_days * day))
    own = Window.partitionBy(*keys, "win")
    return rows.withColumn("evaluation_ms", F.min(F.when(F.col("open_time_ms") >= F.col("_start"), F.col("open_time_ms"))).over(own)).drop("_latest", "_first", "_w", "_start")


def fitness(paths: DataFrame, baselines: DataFrame, run: str = "run_id", penalty: float = 0.0) -> DataFrame:
    """(run, score, max_drawdown, fatal): the weighted sum over windows of the return above the baseline's, less 1.5 times the
    excess drawdown and a penalty per trade; a drawdown of 0.88 or more anywhere is fatal.

    paths: (run, win, weight, open_time_ms, nav, trades); baselines: (win, roi, dd)."""
    w = Window.partitionBy(run, "win").orderBy("open_time_ms")
    per = (
        paths.withColumn("_peak", F.max("nav").over(w))
        .groupBy(run, "win", "weight")
        .agg((F.max_by("nav", "open_time_ms") / F.min_by("nav", "open_time_ms") - 1).alias("_roi"), F.max((F.col("_peak") - F.col("nav")) / F.col("_peak")).alias("_dd"), F.sum("trades").alias("_n"))
        .join(baselines.select("win", "roi", "dd"), "win")
    )
    score = F.col("_roi") - F.col("roi") - 1.5 * F.greatest(F.col("_dd") - F.col("dd"), F.lit(0.0)) - penalty * F.col("_n")
    fatal = F.max(F.col("_dd") >= 0.88)
    return per.groupBy(run).agg(F.when(fatal, F.lit(-99999.0)).otherwise(F.sum(F.col("weight") * score)).alias("score"), F.max("_dd").alias("max_drawdown"), fatal.alias("fatal"))
