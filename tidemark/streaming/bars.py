"""Streams of ticks: bars per window with late data, duplicates, and per-key state across batches.

A bar is final, and given out, once the watermark has passed its end; a tick older than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State and output of the running strategy position.
TICK_STATE = "last_ms long, cash double, quantity double, n long"
TICK_OUT = "key string, open_time_ms long, close double, cash double, quantity double, n long"


def resampled(ticks: DataFrame, keys: list[str], width: str, late: str, time: str = "ts", price: str = "price", order: str = "id") -> DataFrame:
    """Bars of a stream (or table) of ticks per key and window; open and close by (time, order)."""
    by = F.struct(time, order)
    rows = ticks.withWatermark(time, late)
    return (
        rows.groupBy(*keys, F.window(time, width).alias("_w"))
        .agg(F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "open", "high", "low", "close", "volume")
    )


def once(ticks: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """Each key's first arrival; a repeat within the watermark is dropped."""
    return ticks.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(ticks: DataFrame, key: str, gap: str, late: str, time: str = "ts", price: str = "price") -> DataFrame:
    """Spells of a key's ticks with no gap longer than `gap`."""
    rows = ticks.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("_w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("total")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


def _tick(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, cash, quantity, n = state.get if state.exists else (-1, 1000.0, 0.0, 0)
    rows = pd.concat(list(batches)).sort_values("open_time_ms", kind="stable")
    out = []
    for ms, close, target in zip(rows["open_time_ms"], rows["close"], rows["target"]):
        if ms <= last:  # a bar already dealt with
            continue
        equity = cash + quantity * close
        quantity = target * equity / close
        cash = equity - quantity * close
        last, n = int(ms), n + 1
        out.append((key[0], last, float(close), cash, quantity, n))
    state.update((last, cash, quantity, n))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TICK_OUT.split(", ")])


def live_positions(bars: DataFrame, key: str = "key") -> DataFrame:
    """Follows the target weights of a stream of bars (key, open_time_ms, close, target): each new bar once per key, bars not
    above the last one's time are ignored. The state of a key is four numbers."""
    return bars.groupBy(key).applyInPandasWithState(_tick, TICK_OUT, TICK_STATE, "append", GroupStateTimeout.NoTimeout)
