"""Bar relations: open_time_ms, open, high, low, close, volume, with key columns before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

DAY_MS = 86_400_000


def millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp without time zone, read as UTC, whatever the session's zone."""
    name = ts if isinstance(ts, str) else None
    col = F.col(name) if name else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def timestamp(ms: Column | str) -> Column:
    """The timestamp without time zone (UTC) of epoch milliseconds."""
    col = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_add("MILLISECOND", col, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_date(ms: Column | str) -> Column:
    col = F.col(ms) if isinstance(ms, str) else ms
    return F.date_from_unix_date(F.floor(col / DAY_MS).cast("int"))


def to_bars(ticks: DataFrame, keys: list[str], time_ms: Column, price: str, order: list[str], step_ms: int = DAY_MS) -> DataFrame:
    """Bars of ticks per key and step: first and last price by `order`, extremes, and the count as volume."""
    by = F.struct(*order)
    start = (F.floor(time_ms / step_ms) * step_ms).cast("long")
    return ticks.groupBy(*keys, start.alias("open_time_ms")).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series from the order prices."""
    return to_bars(table(spark, sf_dir, "orders"), [], millis("o_orderdate"), "o_totalprice", ["o_orderkey"])


def bars_events(spark: SparkSession, sf_dir: str, step_ms: int = DAY_MS) -> DataFrame:
    """One series for each event type."""
    return to_bars(table(spark, sf_dir, "events"), ["event_type"], millis("ts"), "value", ["ts", "event_id"], step_ms)


def scan(bars: DataFrame, start_ms: int, end_ms: int, limit: int | None = None, latest: bool = False, **equal: str) -> DataFrame:
    """Bars of a key in [start, end], in order of time; with a limit the first, or the latest, so many."""
    rows = bars.where(F.col("open_time_ms").between(start_ms, end_ms))
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    if limit is None:
        return rows.orderBy("open_time_ms")
    if latest:
        return rows.orderBy(F.col("open_time_ms").desc()).limit(limit).orderBy("open_time_ms")
    return rows.orderBy("open_time_ms").limit(limit)


def from_positional_json(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars from JSON arrays of arrays of text or numbers: [[open_time, open, high, low, close, volume, ...], ...].

    Cells that are no numbers become null, as do those a short row lacks."""
    cells = F.from_json(F.col(payload), "array<array<string>>")
    others = [c for c in rows.columns if c != payload]
    one = rows.select(*others, F.explode(cells).alias("_row"))
    kinds = [("open_time_ms", "bigint"), *[(n, "double") for n in ("open", "high", "low", "close", "volume")]]
    return one.select(*others, *[F.try_element_at("_row", F.lit(i + 1)).try_cast(k).alias(n) for i, (n, k) in enumerate(kinds)])


CHART = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>,adjclose:array<double>>"


def from_chart_json(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars from a chart payload of parallel arrays (times in seconds); prices are scaled by
    adjclose / close where both are above 0, and a row with an empty cell is left out."""
    others = [c for c in rows.columns if c != payload]
    parsed = rows.select(*others, F.from_json(F.col(payload), CHART).alias("_p"))
    names = ["timestamp", "open", "high", "low", "close", "volume", "adjclose"]
    one = parsed.select(*others, F.inline(F.arrays_zip(*[F.col(f"_p.{n}").alias(n) for n in names])))
    one = one.na.drop(subset=["timestamp", "open", "high", "low", "close"])
    factor = F.when((F.col("adjclose") > 0) & (F.col("close") > 0), F.col("adjclose") / F.col("close")).otherwise(1.0)
    scaled = [(F.col(n) * factor).alias(n) for n in ("open", "high", "low", "close")]
    return one.select(*others, (F.col("timestamp") * 1000).alias("open_time_ms"), *scaled, F.coalesce("volume", F.lit(0.0)).alias("volume"))


def from_vintages(rows: DataFrame, series_id: str, payload: str = "payload") -> DataFrame:
    """First published value of each observation from {"date": d, "SERIES_yyyymmdd": value, ...}: that of the
    earliest vintage with a number."""
    cells = rows.select(F.from_json(F.col(payload), "map<string,string>").alias("_m"))
    one = cells.select(F.col("_m")["date"].alias("date"), F.explode("_m").alias("key", "value"))
    one = one.where(F.col("key").startswith(f"{series_id}_")).withColumn("vintage", F.substring("key", len(series_id) + 2, 8)).withColumn("value", F.col("value").try_cast("double"))
    return one.where(F.col("value").isNotNull()).groupBy("date").agg(F.min("vintage").alias("vintage"), F.min_by("value", "vintage").alias("value"))


def with_availability(series: DataFrame, delay_days: Column | int, delayed: Column | bool = True) -> DataFrame:
    """Adds avail_ms: the time, plus the release delay for delayed sources."""
    delayed = delayed if isinstance(delayed, Column) else F.lit(delayed)
    days = delay_days if isinstance(delay_days, Column) else F.lit(delay_days)
    return series.withColumn("avail_ms", F.when(delayed, F.col("open_time_ms") + days * DAY_MS).otherwise(F.col("open_time_ms")))


def result_blocks(path: DataFrame, run: list[str], order: str, values: list[str], block: int = 256) -> DataFrame:
    """Blocks of `block` points of each run in order: run, block, n, body (JSON) and its SHA-256."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*(run or [F.lit(0)])).orderBy(order)) - 1
    rows = path.withColumn("_at", at).withColumn("block", F.floor(F.col("_at") / block).cast("long"))
    grouped = rows.groupBy(*run, "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("_at", *values))).alias("_p"))
    body = F.to_json(F.transform("_p", lambda p: F.struct(*[p[v].alias(v) for v in values])))
    return grouped.select(*run, "block", "n", body.alias("body")).withColumn("sha256", F.sha2("body", 256))


def checked_blocks(blocks: DataFrame) -> DataFrame:
    """Adds intact: whether a block's body still has its hash."""
    return blocks.withColumn("intact", F.sha2("body", 256) == F.col("sha256"))

