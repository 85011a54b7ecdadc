"""Performance of NAV paths: returns, distributions, drawdowns, exposure, ratios, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resample import last_of_period, period_key
from tidemark.sources.bars import DAY_MS

YEAR_DAYS = 365.2425


def _w(keys: list[str], time: str = "open_time_ms"):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)


def moments(x: Column | str) -> list[Column]:
    """Mean, population deviation, skewness (m3 / sigma^3) and excess kurtosis."""
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis")]


def quantiles(x: Column | str, at: dict[str, float]) -> list[Column]:
    """Linearly interpolated quantiles, exact."""
    col = F.col(x) if isinstance(x, str) else x
    return [F.percentile(col, F.lit(p)).alias(name) for name, p in at.items()]


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, moments and five numbers of the finite values."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    named = {"minimum": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "maximum": 1.0}
    return rows.where(finite).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *moments(value), *quantiles(value, named))


def period_returns(path: DataFrame, keys: list[str], unit: str, value: str = "nav", time: str = "open_time_ms") -> DataFrame:
    """Return of each period's last row on the one before; the first period has none."""
    last = last_of_period(path, keys, unit, time)
    return last.withColumn("ret", F.try_divide(F.col(value), F.lag(value).over(_w(keys, time))) - 1).where("ret IS NOT NULL")


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins, empty ones too: at most `bins` and no more than there are values; the last holds its
    right edge, and equal values are one bin."""
    stats = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    stats = stats.where("n > 0").withColumn("bins", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.col("n"))).otherwise(1).cast("int"))
    stats = stats.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    every = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    join = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(b))  # the other side has one row
    placed = join(rows.where(F.col(value).isNotNull()), F.broadcast(stats) if not keys else stats)
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("width"), F.lit(0.0))), F.col("bins") - 1)).otherwise(0)
    counts = placed.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = every.join(counts, [*keys, "bin"], "left")
    lower = F.col("lo") + F.col("bin") * F.col("width")
    return out.select(*keys, "bin", lower.alias("lower"), (lower + F.col("width")).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def accumulation(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """Adds the running sum of simple returns and the compounded return since the first row."""
    w = _w(keys)
    rows = path.withColumn("ret", F.coalesce(F.try_divide(F.col(value), F.lag(value).over(w)) - 1, F.lit(0.0)))
    return rows.withColumns({"arithmetic": F.sum("ret").over(w), "compounded": F.try_divide(F.col(value), F.first(value).over(w)) - 1})


def drawdowns(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """Adds peak, drawdown (at or below 0), and the start and number of the spell under water."""
    w = _w(keys)
    rows = path.withColumn("peak", F.max(value).over(w))
    rows = rows.withColumn("drawdown", F.try_divide(F.col(value), F.col("peak")) - 1).withColumn("spell", F.sum((F.col(value) >= F.col("peak")).cast("int")).over(w))
    under = F.col(value) < F.col("peak")
    start = F.min(F.when(under, F.col("open_time_ms"))).over(Window.partitionBy(*keys, "spell"))
    return rows.withColumn("under_ms", F.when(under, F.col("open_time_ms") - start).otherwise(0))


def max_drawdown(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    peak = path.withColumn("_peak", F.max(value).over(_w(keys)))
    return peak.groupBy(*keys).agg(F.max(F.try_divide(F.col("_peak") - F.col(value), F.col("_peak"))).alias("max_drawdown"))


def underwater_spells(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """One row for each spell below the peak: start, end (the recovering row, or the last), points, days, depth,
    recovered, and rank by days, then points, then start."""
    rows = drawdowns(path, keys, value)
    w = _w(keys)
    rows = rows.withColumn("_next", F.lead("open_time_ms").over(w))
    spells = rows.where("drawdown < 0").groupBy(*keys, "spell").agg(
        F.min("open_time_ms").alias("start_ms"), F.max_by(F.struct("_next", "open_time_ms"), "open_time_ms").alias("_l"), F.count(F.lit(1)).alias("points"), F.min("drawdown").alias("depth")
    )
    end = F.coalesce("_l._next", "_l.open_time_ms")
    spells = spells.withColumns({"end_ms": end, "recovered": F.col("_l._next").isNotNull()}).withColumn("days", F.floor((F.col("end_ms") - F.col("start_ms")) / DAY_MS).cast("long"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("days").desc(), F.col("points").desc(), "start_ms")
    return spells.withColumn("rank", F.row_number().over(order)).drop("_l", "spell")


def longest_underwater(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """Days and points of the longest spells, each for itself."""
    return underwater_spells(path, keys, value).groupBy(*keys).agg(F.max("days").alias("max_days"), F.max("points").alias("max_points"))


def exposure(path: DataFrame, keys: list[str], exposed: str = "actual_exposure", value: str = "nav") -> DataFrame:
    """Share of days with exposure, mean exposure, and the return over the mean exposure."""
    daily = last_of_period(path, keys, "day")
    ends = path.groupBy(*keys).agg(F.min_by(value, "open_time_ms").alias("_first"), F.max_by(value, "open_time_ms").alias("_last"))
    e = daily.groupBy(*keys).agg(F.avg((F.col(exposed) > 0).cast("int")).alias("exposed_ratio"), F.avg(exposed).alias("average_exposure"))
    both = e.join(ends, keys) if keys else e.crossJoin(F.broadcast(ends))  # one row each
    adjusted = (F.try_divide(F.col("_last"), F.col("_first")) - 1) / F.nullif(F.col("average_exposure"), F.lit(0.0))
    return both.select(*keys, "exposed_ratio", "average_exposure", adjusted.alias("adjusted_return"))


def cagr(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    ends = path.groupBy(*keys).agg(F.min_by(value, "open_time_ms").alias("_a"), F.max_by(value, "open_time_ms").alias("_b"), ((F.max("open_time_ms") - F.min("open_time_ms")) / DAY_MS).alias("_d"))
    return ends.select(*keys, F.when((F.col("_a") > 0) & (F.col("_b") > 0) & (F.col("_d") > 0), F.pow(F.try_divide(F.col("_b"), F.col("_a")), YEAR_DAYS / F.nullif(F.col("_d"), F.lit(0.0))) - 1).alias("cagr"))


def sortino(path: DataFrame, keys: list[str], risk_free: float = 0.0, value: str = "nav") -> DataFrame:
    """Annualised by observed days; the downside divides by all returns. reason tells why there is no value."""
    r = period_returns(path, keys, "day", value)
    base = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ((F.max("open_time_ms") - F.min("open_time_ms")) / DAY_MS).alias("_d"))
    base = base.withColumn("_ppy", F.when(F.col("_d") > 0, (F.col("n") - 1) * YEAR_DAYS / F.nullif(F.col("_d"), F.lit(0.0))))
    base = base.withColumn("_rf", F.pow(F.lit(1.0 + risk_free), 1 / F.nullif(F.col("_ppy"), F.lit(0.0))) - 1)
    rows = r.select(*keys, "ret")
    rows = rows.join(base, keys) if keys else rows.crossJoin(F.broadcast(base))  # one row
    over = F.col("ret") - F.col("_rf")
    out = rows.groupBy(*keys, "n", "_d", "_ppy").agg(F.avg(over).alias("_mean"), F.sqrt(F.avg(F.pow(F.least(over, F.lit(0.0)), 2))).alias("_down"))
    value_ = F.when(F.col("_down") > 0, F.col("_mean") / F.nullif(F.col("_down"), F.lit(0.0)) * F.sqrt("_ppy"))
    reason = F.when(F.col("n") < 2, "insufficient_observations").when(~(F.col("_d") > 0), "invalid_time_range").when(F.col("_down") <= 0, "no_downside_deviation")
    return out.select(*keys, "n", value_.alias("sortino"), reason.alias("reason"))


def modified_dietz(initial: Column, final: Column, flows: Column, start_ms: Column, end_ms: Column) -> Column:
    """Return with dated flows (array of struct<time_ms, amount>), weighted by the share of days left."""
    days = F.greatest(F.lit(1.0), (end_ms - start_ms) / DAY_MS)
    zero = F.lit(0.0)
    total = F.aggregate(flows, zero, lambda a, f: a + f["amount"])
    weighted = F.aggregate(flows, zero, lambda a, f: a + f["amount"] * (days - (f["time_ms"] - start_ms) / DAY_MS) / days)
    return F.when((initial > 0) & (final > 0) & (end_ms > start_ms), (final - initial - total) / F.nullif(initial + weighted, zero)).otherwise(zero)


def daily_beta(path: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """Beta of a path (nav) on a benchmark (value): returns between days that both have, the last row of a day."""
    a = path.groupBy(*keys, period_key("open_time_ms", "day").alias("day")).agg(F.max_by("nav", "open_time_ms").alias("a"))
    b = benchmark.groupBy(period_key("open_time_ms", "day").alias("day")).agg(F.max_by("value", "open_time_ms").alias("b"))
    w = _w(keys, "day")
    both = a.join(b, "day").withColumns({"ra": F.try_divide(F.col("a"), F.lag("a").over(w)) - 1, "rb": F.try_divide(F.col("b"), F.lag("b").over(w)) - 1}).where("ra IS NOT NULL AND rb IS NOT NULL")
    cov, var = F.covar_pop("ra", "rb"), F.var_pop("rb")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (cov / F.nullif(var, F.lit(0.0))).alias("beta"), F.corr("ra", "rb").alias("correlation"))


def report(path: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """The performance report of each path: daily moments and quantiles, drawdown, longest spell, CAGR, Sortino."""
    daily = period_returns(path, keys, "day", value)
    dist = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_returns"), *moments("ret"), *quantiles("ret", {"p05": 0.05, "median": 0.5, "p95": 0.95}))
    parts = [dist, max_drawdown(path, keys, value), longest_underwater(path, keys, value), cagr(path, keys, value), sortino(path, keys, 0.0, value).drop("n", "reason")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left") if keys else out.crossJoin(F.broadcast(p))  # one row each
    return out
