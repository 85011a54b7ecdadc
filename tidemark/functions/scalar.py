"""Scalar expressions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within the bounds, which may be given in either order."""
    return F.greatest(F.least(x, F.lit(max(low, high))), F.lit(min(low, high)))


def cents(x: Column) -> Column:
    """Rounded to cents, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def exposure_weight(asset: Column, equity: Column) -> Column:
    """asset / equity in [0, 1], 0 where that makes no sense."""
    ok = (equity > 0) & asset.isNotNull() & ~F.isnan(asset)
    return F.when(ok, clip(asset / F.nullif(equity, F.lit(0.0)), 0, 1)).otherwise(0.0)


def cost_rate(x: Column) -> Column:
    """A fee or spread: 0 where null, NaN or negative."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(x)


def buy_quantity(cash: Column, price: Column, fee: Column | float, spread: Column | float) -> Column:
    """What cash buys at the price with spread and fee on top; 0 where cash or price is not above 0."""
    fee, spread = (c if isinstance(c, Column) else F.lit(c) for c in (fee, spread))
    return F.when((cash > 0) & (price > 0), cash / (F.nullif(price, F.lit(0.0)) * (1 + cost_rate(spread)) * (1 + cost_rate(fee)))).otherwise(0.0)


def sell_proceeds(quantity: Column, price: Column, fee: Column | float, spread: Column | float) -> Column:
    """Cash for a quantity at the price less spread and fee, never below 0."""
    fee, spread = (c if isinstance(c, Column) else F.lit(c) for c in (fee, spread))
    return F.when((quantity > 0) & (price > 0), F.greatest(quantity * price * (1 - cost_rate(spread)) * (1 - cost_rate(fee)), F.lit(0.0))).otherwise(0.0)


def percent_change(now: Column, before: Column) -> Column:
    """now / before - 1, and 0 where before is missing or not above 0."""
    return F.when(before > 0, now / F.nullif(before, F.lit(0.0)) - 1).otherwise(0.0)


def bounded_sigmoid(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) / (1 + F.exp(-clip(x, -700, 700)))


def reflected(x: Column) -> Column:
    """x folded back into [0, 1]."""
    v = F.pmod(x, F.lit(2.0))
    return F.least(v, 2 - v)


def lattice(x: Column, low: float, high: float, step: float = 0.05) -> Column:
    """The nearest multiple of step within the bounds."""
    return clip(F.round(x / step) * step, low, high)


def trailing(values: Column, period: Column) -> Column:
    """The last `period` values of an array; all of them where that is 0 or less, or more than there are."""
    return F.when((period <= 0) | (period >= F.size(values)), values).otherwise(F.slice(values, -F.greatest(period, F.lit(1)), F.greatest(period, F.lit(1))))


def symbol(x: Column) -> Column:
    return F.upper(F.trim(x))


def repaired(open_: Column, high: Column, low: Column, close: Column) -> list[Column]:
    """OHLC with zero or missing fields filled from the close, and extremes that hold the others."""
    fill = lambda c, other: F.when(c > 0, c).otherwise(other)
    c = fill(close, open_)
    o = fill(open_, c)
    h, lo = fill(high, F.greatest(o, c)), fill(low, F.least(o, c))
    return [o, F.greatest(h, o, c), F.least(lo, o, c), c]


def valid_ohlc(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """All above 0 and finite, high the most and low the least."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (c > 0)
    return finite(open_) & finite(high) & finite(low) & finite(close) & (high >= F.greatest(open_, close, low)) & (low <= F.least(open_, close))


def metrics(s_final: Column, b_final: Column, s_dd: Column, b_dd: Column) -> dict[str, Column]:
    """Relative metrics of a strategy against a benchmark: log ratio, log residual, composite, qualified."""
    ratio = F.when((s_final > 0) & (b_final > 0), s_final / F.nullif(b_final, F.lit(0.0)))
    residual = F.when((s_dd < 1) & (b_dd < 1), (1 - s_dd) / F.nullif(1 - b_dd, F.lit(0.0)))
    return {
        "log_final_nav_ratio": F.log(ratio),
        "log_drawdown_residual_ratio": F.log(residual),
        "performance_drawdown_composite": F.log(ratio) * residual,
        "qualified": (s_final > b_final) & (s_dd < b_dd),
    }


def outcome(strategy: Column, benchmark: Column, initial: Column) -> Column:
    """Classes of a result by gain (A: above the initial capital or, if not, above the benchmark) and rank (B)."""
    return (
        F.when((strategy > initial) & (strategy > benchmark), "a_and_b")
        .when(strategy > initial, "positive_but_below_dca")
        .when(strategy > benchmark, "a_only")
        .otherwise("neither")
    )


#: Coefficients of the rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """The quantile of the normal distribution by a rational approximation; null outside (0, 1)."""
    tail = F.sqrt(-2 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))
    edge = _poly(tail, ACKLAM_C) / _poly(tail, (*ACKLAM_D, 1.0))
    q = p - 0.5
    r = q * q
    middle = q * _poly(r, ACKLAM_A) / _poly(r, (*ACKLAM_B, 1.0))
    return F.when((p > 0) & (p < 0.02425), edge).when((p > 1 - 0.02425) & (p < 1), -edge).when((p > 0) & (p < 1), middle)


#: Coefficients of the rational approximation of the normal distribution function.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function to about 1e-14, by expressions alone."""
    a = F.least(F.abs(x), F.lit(37.0))
    e = F.exp(-a * a / 2)
    near = e * _poly(a, CDF_TOP) / _poly(a, CDF_BOTTOM)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + k / far
    tail = F.when(a < 7.07106781186547, near).otherwise(e / far / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def feature_distance(a: Column, b: Column) -> Column:
    """Half the mean square of each half's differences, for arrays of even length."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return square / F.size(a)


def month_key(ms: Column) -> Column:
    """YYYY-MM in UTC."""
    return F.date_format(F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")), "yyyy-MM")


def relative_performance(s_final: Column, b_final: Column, s_return: Column, b_return: Column, s_dd: Column, b_dd: Column) -> dict[str, Column]:
    """As metrics(), but qualified by returns, not by final values."""
    return metrics(s_final, b_final, s_dd, b_dd) | {"qualified": (s_return > b_return) & (s_dd < b_dd)}


def to_middle_body(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Log middle, body and wicks of a bar."""
    o, h, lo, c = (F.log(x) for x in (open_, high, low, close))
    return {"middle": (o + c) / 2, "body": c - o, "upper": h - F.greatest(o, c), "lower": F.least(o, c) - lo}


def from_middle_body(middle: Column, body: Column, upper: Column, lower: Column) -> dict[str, Column]:
    o, c = middle - body / 2, middle + body / 2
    return {"open": F.exp(o), "high": F.exp(F.greatest(o, c) + upper), "low": F.exp(F.least(o, c) - lower), "close": F.exp(c)}


def progress(valid: Column, total: Column) -> Column:
    """Share of valid items in [0, 1], 0 without items."""
    return F.when(total > 0, clip(valid / F.nullif(total, F.lit(0)), 0, 1)).otherwise(0.0)


def task_status(total: Column, valid: Column, running: Column, pending: Column, failed: Column, started: Column, cancel: Column) -> Column:
    """Status of a task from the counts of its items."""
    return (
        F.when(cancel, F.when(running > 0, "running").otherwise("cancelled"))
        .when(total <= 0, F.when(started, "completed").otherwise("planned"))
        .when(valid == total, "completed")
        .when(running > 0, "running")
        .when(~started, "planned")
        .when(pending > 0, "queued")
        .when(valid > 0, "partial")
        .when(failed > 0, "failed")
        .otherwise("cancelled")
    )


def canonical_decimal(x: Column) -> Column:
    """A number's plain decimal text without leading or trailing zeros; null for what is no number."""
    text = F.trim(x).try_cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def fingerprint(*values: Column) -> Column:
    """A 64-bit hash of values to six digits."""
    return F.xxhash64(*[F.round(v * 1_000_000).cast("long") for v in values])


def radical_inverse(i: Column, base: int, digits: int | None = None) -> Column:
    """The Halton coordinate of a counter: its digits in the base, mirrored at the point."""
    digits = digits or math.ceil(40 / math.log2(base))
    places = F.sequence(F.lit(0), F.lit(digits - 1))
    term = lambda acc, k: acc + F.pmod(F.floor(i / F.pow(F.lit(float(base)), k)), F.lit(base)) / F.pow(F.lit(float(base)), k + 1)
    return F.aggregate(places, F.lit(0.0), term)


def keyed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts: its first 13 hex digits over 16^13."""
    key = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / float(16**13)


def triangular(*parts: Column) -> Column:
    """The difference of two keyed uniform numbers."""
    return keyed_uniform(*parts, F.lit(0)) - keyed_uniform(*parts, F.lit(1))


def prefixed_sha256(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def region_key(features: list[Column], thresholds: list[list[float]], names: list[str]) -> Column:
    """`name=bucket` parts, the bucket being how many thresholds lie below the feature."""
    parts = [F.concat(F.lit(f"{n}="), sum((F.when(f > t, 1).otherwise(0) for t in ts), F.lit(0)).cast("string")) for f, ts, n in zip(features, thresholds, names)]
    return F.concat_ws(";", *parts)
