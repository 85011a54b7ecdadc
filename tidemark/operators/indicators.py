"""Causal indicators over ordered bars: each row sees its own and earlier rows only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.orderstats import prefix_median

FAST, SLOW, VOL_SHORT = 21, 112, 16


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0: a bar with a price of 0 has no ratios and does not count in means over them."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a / b) of positive prices, else null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((a > 0) & (b > 0), F.log(F.try_divide(a, b)))


def true_range_ratio(before: Column) -> Column:
    """The true range over a positive close before, else null."""
    widest = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before > 0, F.try_divide(widest, before))


def activity_terms(before: Column) -> dict[str, Column]:
    """What activity features are means and deviations of, bar by bar; null where a price needed is not positive."""
    return {
        "_tr": true_range_ratio(before),
        "_hl": log_ratio("high", "low"),
        "_on": log_ratio(F.col("open"), before),
        "_oc": log_ratio("close", "open"),
        "_rs": log_ratio("high", "close") * log_ratio("high", "open") + log_ratio("low", "close") * log_ratio("low", "open"),
    }


def window(keys: list[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("open_time_ms")


def ema(rows: DataFrame, keys: list[str], period: int, value: str = "close", to: str = "ema", chunk: int = 256) -> DataFrame:
    """Exponential mean over the whole prefix, seeded with the first value; alpha is 2 / (period + 1).

    Linear in its state, so it is computed in chunks: within a chunk the weighted sum of its own rows,
    then the state that the chunks before hand on. Every weight stays a power below one. Chunks so far back that
    their weight is below 2^-200 lie beyond a double's digits and are not read again (one that holds a NaN still counts), so a
    row's cost depends on the period, not on the length of the series.
    """
    if period <= 1:
        return rows.withColumn(to, F.col(value))
    keep = 1 - 2 / (period + 1)
    w = window(keys)
    at = F.row_number().over(w) - 1
    seeded = rows.withColumn("_i", at).withColumn("_x", F.when(F.col("_i") == 0, F.col(value)).otherwise((1 - keep) * F.col(value)))
    seeded = seeded.withColumns({"_c": F.floor(F.col("_i") / chunk), "_o": F.col("_i") % chunk})
    inside = Window.partitionBy(*keys, "_c").orderBy("_o")
    # sum of x_j * keep^(o - j): powers stay within keep^-chunk, far from overflow for the periods in use
    own = seeded.withColumn("_s", F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_o"))).over(inside) * F.pow(F.lit(keep), F.col("_o")))
    last = own.groupBy(*keys, "_c").agg(F.max_by("_s", "_o").alias("_s"), (F.max("_o") + 1).alias("_n"))
    chunks = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_c")
    before = chunks.rowsBetween(-max(1, math.ceil(200 / (chunk * -math.log2(keep)))), -1)
    spoilt = F.coalesce(F.max(F.isnan("_s")).over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    fold = lambda a, p: F.struct((a["s"] * F.pow(F.lit(keep), p["_n"]) + p["_s"]).alias("s"))
    state = F.aggregate(F.collect_list(F.struct("_s", "_n")).over(before), F.struct(F.lit(0.0).alias("s")), fold)["s"]
    carried = last.select(*keys, "_c", F.when(spoilt, float("nan")).otherwise(state).alias("_state"))
    out = own.join(carried, [*keys, "_c"])
    return out.withColumn(to, F.col("_s") + F.coalesce("_state", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_o") + 1)).drop("_i", "_x", "_c", "_o", "_s", "_state")


def trailing_std(x: Column | str, w, period: int) -> Column:
    """Sample deviation of the trailing rows, 0 for fewer than two."""
    return F.coalesce(F.stddev_samp(x).over(w.rowsBetween(-(period - 1), 0)), F.lit(0.0))


def mean_abs_change(rows: DataFrame, keys: list[str], period: int, to: str, value: str = "close") -> DataFrame:
    """Mean absolute change within the trailing `period` rows: period - 1 differences."""
    w = window(keys)
    step = rows.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    return step.withColumn(to, F.coalesce(F.avg("_d").over(w.rowsBetween(-(period - 2), 0)), F.lit(0.0))).drop("_d")


def volatility_ratio(rows: DataFrame, keys: list[str], value: str = "close", to: str = "volatility_ratio") -> DataFrame:
    """Short over long mean change in [0.1, 3]; 1 if either is not above 0."""
    out = mean_abs_change(mean_abs_change(rows, keys, VOL_SHORT, "_s", value), keys, SLOW, "_l", value)
    clipped = F.least(F.greatest(ratio("_s", "_l"), F.lit(0.1)), F.lit(3.0))
    return out.withColumn(to, F.when((F.col("_s") > 0) & (F.col("_l") > 0), clipped).otherwise(1.0)).drop("_s", "_l")


def indicators(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the columns that signals and regimes share: ema_fast, ema_slow, volatility_ratio, high_slow, log_return,
    sigma (of the last 21 log returns), momentum (21-bar log return) and n (rows so far)."""
    w = window(keys)
    rows = volatility_ratio(ema(ema(bars, keys, FAST, to="ema_fast"), keys, SLOW, to="ema_slow"), keys)
    rows = rows.withColumns(
        {
            "n": F.row_number().over(w),
            "high_slow": F.max("close").over(w.rowsBetween(-(SLOW - 1), 0)),
            "log_return": log_ratio(F.col("close"), F.lag("close").over(w)),
            "momentum": log_ratio(F.col("close"), F.lag("close", FAST).over(w)),
        }
    )
    return rows.withColumn("sigma", trailing_std("log_return", w, FAST))


def micro_signal(rows: DataFrame, reversion: float = 1.0, momentum: float = 1.0, breakout: float = 1.0) -> DataFrame:
    """Adds signal to indicators(): weighted mean reversion, momentum and breakout; null before 22 rows."""
    sigma = F.greatest(F.col("sigma"), F.lit(0.001))
    s = (
        reversion * (ratio("close", "ema_fast") - 1) / sigma
        + momentum * F.coalesce("momentum", F.lit(0.0))
        + breakout * (ratio("close", "high_slow") - 1)
    )
    return rows.withColumn("signal", F.when(F.col("n") >= FAST + 1, s))


def is_shock() -> Column:
    """Whether a row of indicators() is a shock: a volatility ratio over 1.8, or a last return of over 2.5 deviations of the 21 that hold it."""
    return (F.col("volatility_ratio") > 1.8) | ((F.col("n") >= FAST + 2) & (F.col("sigma") > 0) & (F.abs("log_return") > 2.5 * F.col("sigma")))


def market_regime(rows: DataFrame) -> DataFrame:
    """Adds regime, time_multiplier, beta_multiplier and is_quiet to indicators()."""
    slope, depth = ratio("ema_fast", "ema_slow") - 1, ratio("close", "high_slow") - 1
    calm = (F.col("volatility_ratio") < 0.75) & (F.abs(ratio("close", "ema_fast") - 1) < 0.015)
    early = F.col("n") < FAST + 1
    which = F.when(early, "early").when(is_shock(), "shock").when((slope < -0.03) | (depth < -0.2), "bear").when((slope > 0.03) & (F.coalesce("momentum", F.lit(0.0)) > 0), "bull").when(calm, "calm").otherwise("plain")
    of = lambda **v: F.element_at(F.create_map(*[F.lit(x) for kv in v.items() for x in kv]), F.col("_which"))
    out = rows.withColumns({"trend_slope": slope, "depth": depth, "_which": which})
    return out.withColumns(
        {
            "regime": of(early="quiet", shock="shock", bear="bear", bull="bull", calm="quiet", plain="quiet"),
            "time_multiplier": of(early=1.0, shock=1.5, bear=1.25, bull=0.85, calm=1.0, plain=1.0),
            "beta_multiplier": of(early=0.65, shock=1.4, bear=1.15, bull=1.0, calm=0.65, plain=1.0),
            "is_quiet": F.col("_which").isin("early", "calm"),
        }
    ).drop("_which")


def long_term_filter(bars: DataFrame, keys: list[str], months: int) -> DataFrame:
    """Adds filter_state to bars: 1 or -1 as the mean of the last `months` month-end closes rose or fell against
    the one before, kept where equal; a month counts once a bar of a later month is there."""
    w = window(keys)
    month = F.floor(F.months_between(F.date_trunc("month", F.timestamp_millis("open_time_ms").cast("timestamp_ntz").cast("date")), F.lit("1970-01-01").cast("date"))).cast("int")
    rows = bars.withColumn("_m", month)
    ends = rows.withColumn("_next", F.lead("_m").over(w)).where("_next > _m").select(*keys, "open_time_ms", "close")
    full = F.count(F.lit(1)).over(w.rowsBetween(-(months - 1), 0)) == months
    ends = ends.withColumn("_sma", F.when(full, F.avg("close").over(w.rowsBetween(-(months - 1), 0))))
    sign = F.signum(F.col("_sma") - F.lag("_sma").over(w))
    ends = ends.withColumn("_sign", F.when(sign != 0, sign)).withColumn("_state", F.last("_sign", ignorenulls=True).over(w))
    marked = rows.join(ends.select(*keys, "open_time_ms", "_state"), [*keys, "open_time_ms"], "left")
    # a month's end is known from the next bar on
    known = F.last("_state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("filter_state", known.cast("int")).drop("_m", "_state")


def activity(bars: DataFrame, keys: list[str], lookback: int) -> DataFrame:
    """Adds six causal activity features over the lookback: mean and deviation of true range and of ln(high/low),
    Parkinson and Yang-Zhang volatility. Terms that need the bar before use lookback - 1 rows."""
    w = window(keys)
    before = F.lag("close").over(w)
    rows = bars.withColumns({**activity_terms(before), "_n": F.row_number().over(w)})
    whole, short = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(-(lookback - 2), 0)
    k = 0.34 / (1.34 + (lookback + 1) / (lookback - 1))
    yz = F.var_samp("_on").over(short) + k * F.var_samp("_oc").over(whole) + (1 - k) * F.avg("_rs").over(whole)
    ready = lambda c: F.when(F.col("_n") >= lookback, c)
    return rows.withColumns(
        {
            "tr_mean": ready(F.avg("_tr").over(short)),
            "tr_std": ready(F.stddev_samp("_tr").over(short)),
            "hl_mean": ready(F.avg("_hl").over(whole)),
            "hl_std": ready(F.stddev_samp("_hl").over(whole)),
            "parkinson": ready(F.sqrt(F.avg(F.col("_hl") * F.col("_hl")).over(whole) / (4 * F.log(F.lit(2.0))))),
            "yang_zhang": ready(F.sqrt(F.greatest(yz, F.lit(0.0)))),
        }
    ).drop("_tr", "_hl", "_on", "_oc", "_rs", "_n")


def history_ratio(rows: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """The value over the median of all strictly earlier positive values; null without any."""
    counted = rows.withColumn("_p", F.when(F.col(value) > 0, F.col(value)))
    return prefix_median(counted, keys, "open_time_ms", "_p", "_h", 1).withColumn(to, ratio(value, "_h")).drop("_h", "_p")


def forward_targets(bars: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Adds direction, up and down (largest log moves within the horizon) and, where an earlier completed target has a
    positive sum, normaliser (the median of those sums)."""
    w = window(keys)
    ahead = w.rowsBetween(1, horizon)
    rows = bars.withColumns({"_end": F.lead("close", horizon).over(w), "_hi": F.max("high").over(ahead), "_lo": F.min("low").over(ahead)})
    rows = rows.where("_end IS NOT NULL").withColumns(
        {
            "direction": (F.col("_end") > F.col("close")).cast("int"),
            "up": F.when(F.col("close") > 0, F.greatest(log_ratio("_hi", "close"), F.lit(0.0))),
            "down": F.when(F.col("_lo") > 0, F.greatest(log_ratio("close", "_lo"), F.lit(0.0))),
        }
    )
    total = F.col("up") + F.col("down")
    rows = rows.withColumn("_t", F.when(total > 0, total)).drop("_end", "_hi", "_lo")
    return prefix_median(rows, keys, "open_time_ms", "_t", "normaliser", horizon).drop("_t")


def rolling_slope(bars: DataFrame, keys: list[str], lookback: int, value: str = "close") -> DataFrame:
    """Adds the least-squares slope of the value on the row number over the lookback."""
    w = window(keys)
    rows = bars.withColumn("_i", F.row_number().over(w).cast("double"))
    return rows.withColumn("slope", F.when(F.col("_i") >= lookback, F.regr_slope(value, "_i").over(w.rowsBetween(-(lookback - 1), 0)))).drop("_i")


def walk_forward_folds(rows: DataFrame, keys: list[str], min_train: int, purge: int, folds: int) -> DataFrame:
    """(keys, fold, train_end, validation_start, validation_end) by count of rows: expanding training, purged; ends are
    inclusive, and the last fold runs to the end."""
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else rows.agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor((F.col("_n") - min_train - purge) / folds)
    out = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = min_train + purge + F.col("fold") * block
    return out.select(*keys, "fold", (start - purge - 1).alias("train_end"), start.alias("validation_start"), F.when(F.col("fold") == folds - 1, F.col("_n") - 1).otherwise(start + block - 1).alias("validation_end"))


def coordinates(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Adds log gap, body, upper and lower wick of each bar after the first.

    A bar with a price that is not positive has no coordinates and is left out; the gap of the next is from the last close before it."""
    priced = bars.where(F.least("open", "high", "low", "close") > 0)
    rows = priced.withColumn("g", log_ratio(F.col("open"), F.lag("close").over(window(keys)))).where("g IS NOT NULL")
    return rows.withColumns({"b": log_ratio("close", "open"), "u": log_ratio(F.col("high"), F.greatest("open", "close")), "d": log_ratio(F.least("open", "close"), F.col("low"))})


def from_coordinates(path: DataFrame, keys: list[str], first_close: float) -> DataFrame:
    """OHLC from coordinates: the close is the running product of gaps and bodies."""
    w = window(keys)
    close = first_close * F.exp(F.sum(F.col("g") + F.col("b")).over(w))
    rows = path.withColumn("close", close).withColumn("open", F.col("close") / F.exp("b"))
    return rows.withColumns({"high": F.greatest("open", "close") * F.exp("u"), "low": F.least("open", "close") / F.exp("d")})


def true_range_log(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Adds scale: the log true range against the close before; parts with a price that is not positive do not count."""
    before = F.lag("close").over(window(keys))
    return bars.withColumn("scale", F.greatest(log_ratio("high", "low"), F.abs(log_ratio(F.col("high"), before)), F.abs(log_ratio(F.col("low"), before))))
