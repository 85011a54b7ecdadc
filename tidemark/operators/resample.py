"""Calendars and resampling: periods in a market's time zone, session times, adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import millis, timestamp, utc_date

#: Opening and closing times of a market's regular day.
SESSIONS = {
    "America/New_York": ("09:30", "16:00"),
    "Asia/Taipei": ("09:00", "13:30"),
    "UTC": ("00:00", "24:00"),
}


def local(ms: Column | str, tz: str) -> Column:
    """Wall clock in a zone, as a timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), timestamp(ms))


def from_local(ts: Column, tz: str) -> Column:
    """Epoch milliseconds of a wall clock in a zone."""
    return millis(F.convert_timezone(F.lit(tz), F.lit("UTC"), ts))


def period_start(ms: Column | str, unit: str, tz: str = "UTC") -> Column:
    """Start of the day, week (Monday) or month in the zone."""
    return from_local(F.date_trunc(unit, local(ms, tz)).cast("timestamp_ntz"), tz)


def period_end(start_ms: Column | str, unit: str, tz: str = "UTC") -> Column:
    """Start of the period after the one that starts then."""
    step = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY"}[unit]
    return from_local(local(start_ms, tz) + F.expr(step), tz)


def _minutes(clock: str) -> int:
    h, m = clock.split(":")
    return int(h) * 60 + int(m)


def session_open(ms: Column | str, tz: str) -> Column:
    """The regular opening of the local day."""
    return from_local(F.timestamp_add("MINUTE", F.lit(_minutes(SESSIONS[tz][0])), F.date_trunc("day", local(ms, tz)).cast("timestamp_ntz")), tz)


def session_close(ms: Column | str, tz: str) -> Column:
    return from_local(F.timestamp_add("MINUTE", F.lit(_minutes(SESSIONS[tz][1])), F.date_trunc("day", local(ms, tz)).cast("timestamp_ntz")), tz)


def is_canonical_open(ms: Column | str, tz: str, unit: str = "day") -> Column:
    """Whether a daily bar opens with the session, or a longer one with its period."""
    col = F.col(ms) if isinstance(ms, str) else ms
    return col == (session_open(ms, tz) if unit == "day" else period_start(ms, unit, tz))


def completed_daily(bars: DataFrame, tz: str, now_ms: int, grace_minutes: int = 90) -> DataFrame:
    """Rows that open with the session and whose close, plus a grace, lies in the past."""
    return bars.where(is_canonical_open("open_time_ms", tz) & (session_close("open_time_ms", tz) + grace_minutes * 60_000 <= now_ms))


def resample(bars: DataFrame, keys: list[str], unit: str, tz: str = "UTC", as_of_ms: int | None = None) -> DataFrame:
    """Weekly or monthly bars from daily ones; a period that has not ended by as_of_ms is left out."""
    start = period_start("open_time_ms", unit, tz)
    out = bars.groupBy(*keys, start.alias("period_ms")).agg(
        F.min_by("open", "open_time_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time_ms").alias("close"),
        F.sum("volume").alias("volume"),
    )
    if as_of_ms is not None:
        out = out.where(period_end("period_ms", unit, tz) <= as_of_ms)
    return out.withColumnRenamed("period_ms", "open_time_ms").select(*keys, "open_time_ms", "open", "high", "low", "close", "volume")


def iso_week(date: Column) -> Column:
    """YYYY-Www with the ISO year."""
    return F.concat(F.extract(F.lit("yearofweek"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def period_key(ms: Column | str, unit: str) -> Column:
    """Text key of the UTC day, ISO week or month."""
    date = utc_date(ms)
    return {"day": F.date_format(date, "yyyy-MM-dd"), "week": iso_week(date), "month": F.date_format(date, "yyyy-MM")}[unit]


def last_of_period(path: DataFrame, keys: list[str], unit: str, time: str = "open_time_ms") -> DataFrame:
    """The last row of each key and period, with its period key."""
    others = [c for c in path.columns if c not in keys]
    last = path.groupBy(*keys, period_key(time, unit).alias("period")).agg(F.max_by(F.struct(*others), time).alias("_r"))
    return last.select(*keys, "period", *[F.col(f"_r.{c}").alias(c) for c in others])


def preclose_snapshots(ticks: DataFrame, keys: list[str], tz: str, before: int = 10, early: int = 20, late: int = 15) -> DataFrame:
    """For each key and local date the row nearest to `before` minutes ahead of the close, from `early` minutes
    before that time to `late` after it; of two as near the earlier one."""
    away = F.col("open_time_ms") - (session_close("open_time_ms", tz) - before * 60_000)
    rows = ticks.withColumn("away_ms", away).withColumn("trade_date", F.to_date(local("open_time_ms", tz)))
    rows = rows.where(F.col("away_ms").between(-early * 60_000, late * 60_000))
    order = Window.partitionBy(*keys, "trade_date").orderBy(F.abs("away_ms"), "open_time_ms")
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def back_adjusted(bars: DataFrame, keys: list[str], low: float = 0.35, high: float = 2.85) -> DataFrame:
    """Scales all rows before a jump of the close out of [low, high] by that jump."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("open_time_ms")
    ratio = F.try_divide(F.col("close"), F.lag("close").over(w))  # null, hence no jump, after a close of 0
    rows = bars.withColumn("_jump", F.when((ratio < low) | (ratio > high), ratio).otherwise(1.0))
    back = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("open_time_ms").desc()).rowsBetween(Window.unboundedPreceding, -1)
    factor = F.exp(F.coalesce(F.sum(F.log(F.when(F.col("_jump") > 0, F.col("_jump")))).over(back), F.lit(0.0)))
    rows = rows.withColumn("_f", factor)
    return rows.select(*keys, "open_time_ms", *[(F.col(c) * F.col("_f")).alias(c) for c in ("open", "high", "low", "close")], "volume")


def leveraged(bars: DataFrame, keys: list[str], multiple: float, base: float = 10_000.0) -> DataFrame:
    """A child series whose daily return is `multiple` times the parent's: opens and closes.

    The first bar's previous close is its own `previous_close` column, if there is one, else its open."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("open_time_ms")
    first = F.coalesce(F.col("previous_close"), F.col("open")) if "previous_close" in bars.columns else F.col("open")
    before = F.coalesce(F.lag("close").over(w), first)
    rows = bars.withColumn("_before", before)
    growth = lambda c: 1 + multiple * F.coalesce(F.try_divide(F.col(c), F.col("_before")) - 1, F.lit(0.0))
    rows = rows.withColumn("_close", base * F.product(growth("close")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.coalesce(F.lag("_close").over(w), F.lit(base))
    return rows.select(*keys, "open_time_ms", (start * growth("open")).alias("open"), F.col("_close").alias("close"))


def previous_business_day(date: Column) -> Column:
    """The day before, or the Friday before a weekend or Monday."""
    return F.date_sub(date, F.when(F.dayofweek(date) == 2, 3).when(F.dayofweek(date) == 1, 2).otherwise(1))


