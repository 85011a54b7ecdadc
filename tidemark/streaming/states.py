"""Structural states of a stream of bars: direction and volatility with hysteresis, their occurrences and the deviation from the occurrence's trend.

Rows wait in their key's state until the watermark has passed their time and are then dealt with in the order of time, so the result is that of
`operators.states` over the whole table, however the stream was cut into batches. What waits is what the watermark's delay holds; what stays
of a key is one row of numbers. A key is woken by a timer at its earliest waiting row.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: What stays of a key: the state, its occurrence, the line through the occurrence's rows (means and sums of products about them), the line's
#: one-step errors (count, mean, sum of squares about it), the last time dealt with, the timer, and what was refused.
STATE = (
    "direction string, high boolean, state string, occurrence long, start_ms long, n long, mean_x double, mean_y double, xx double, xy double, "
    "errors long, mean_e double, ee double, last_ms long, timer_ms long, late long, again long"
)
FRESH = ("uncertain", False, "", 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, -(1 << 62), -1, 0, 0)
FIELDS = tuple(c.split()[0] for c in STATE.split(", "))
OUT = "open_time_ms long, direction string, volatility string, state string, occurrence long, start_ms long, trend_deviation double, late long, again long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _States(StatefulProcessor):
    """Keeps a key's waiting rows and its state; rules are those of `operators.states`."""

    def __init__(self, key_type: str, entry: float, thresholds: list[float], hysteresis: tuple[float, float]) -> None:
        self.key_type, self.entry, self.thresholds = key_type, entry, thresholds
        self.leave = 0.5 + hysteresis[0] * (entry - 0.5)
        self.keep = [1 + hysteresis[1] * (t - 1) for t in thresholds]
        self.columns = ["time_ms", "close", "p", *[f"r{i}" for i in range(len(thresholds))]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", STATE)
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {'long' if c == 'time_ms' else 'double'}" for c in self.columns))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = self._state()
        for part in rows:
            fresh = part[part["time_ms"] > now["last_ms"]]
            now["late"] += len(part) - len(fresh)
            if len(fresh):
                self.waiting.appendList(list(fresh[self.columns].itertuples(index=False, name=None)))
                self._wake(now, int(fresh["time_ms"].min()))
        self._keep(now)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = self._state()
        until = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        due: dict[int, tuple] = {}
        later, now["timer_ms"] = [], -1
        for row in self.waiting.get():
            if row[0] > until:
                later.append(row)
            elif row[0] in due:
                now["again"] += 1
                due[row[0]] = max(due[row[0]], row)
            else:
                due[row[0]] = row
        out = [self._step(now, due[t]) for t in sorted(due)]
        if later:
            self.waiting.put(later)
            self._wake(now, min(r[0] for r in later))
        else:
            self.waiting.clear()
        self._keep(now)
        if out:
            found = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            found.insert(0, "key", pd.Series([key[0]] * len(found), dtype=object))
            yield found

    def close(self) -> None:
        pass

    def _state(self) -> dict:
        return dict(zip(FIELDS, self.kept.get() if self.kept.exists() else FRESH))

    def _keep(self, now: dict) -> None:
        self.kept.update(tuple(now[f] for f in FIELDS))

    def _wake(self, now: dict, at: int) -> None:
        """One timer a key, at its earliest waiting row."""
        if now["timer_ms"] != -1:
            if now["timer_ms"] <= at:
                return
            self.handle.deleteTimer(now["timer_ms"])
        self.handle.registerTimer(at)
        now["timer_ms"] = at

    def _step(self, now: dict, row: tuple) -> tuple:
        time, close, p, *ratios = row
        if not math.isnan(p):
            if p >= self.entry:
                now["direction"] = "up"
            elif p <= 1 - self.entry:
                now["direction"] = "down"
            elif not (now["direction"] == "up" and p >= self.leave or now["direction"] == "down" and p <= 1 - self.leave):
                now["direction"] = "uncertain"
        now["high"] = any(r > t for r, t in zip(ratios, self.thresholds)) or (now["high"] and any(r >= k for r, k in zip(ratios, self.keep)))
        volatility = "high" if now["high"] else "low"
        state = f"{now['direction']}_{volatility}"
        if state != now["state"]:
            now |= {"state": state, "occurrence": now["occurrence"] + 1, "start_ms": time, "n": 0, "mean_x": 0.0, "mean_y": 0.0, "xx": 0.0, "xy": 0.0, "errors": 0, "mean_e": 0.0, "ee": 0.0}
        now["last_ms"] = time
        return (time, now["direction"], volatility, state, now["occurrence"], now["start_ms"], _deviation(now, close), now["late"], now["again"])


def _deviation(now: dict, close: float) -> float:
    """How far ln(close) lies from the line through the occurrence's earlier rows, in deviations of its one-step errors; then the row joins the line."""
    x, y, found = float(now["n"]), math.log(close), math.nan
    if now["n"] >= 2:
        error = y - now["mean_y"] - now["xy"] / now["xx"] * (x - now["mean_x"])
        if now["errors"] > 1 and now["ee"] > 0:
            found = error / math.sqrt(now["ee"] / (now["errors"] - 1))
        now["errors"] += 1
        off = error - now["mean_e"]
        now["mean_e"] += off / now["errors"]
        now["ee"] += off * (error - now["mean_e"])
    now["n"] += 1
    dx, dy = x - now["mean_x"], y - now["mean_y"]
    now["mean_x"] += dx / now["n"]
    now["mean_y"] += dy / now["n"]
    now["xx"] += dx * (x - now["mean_x"])
    now["xy"] += dx * (y - now["mean_y"])
    return found


def streamed_states(
    bars: DataFrame, key: str, probability: str, ratios: dict[str, float], delay: str, entry: float = 0.6, direction_hysteresis: float = 0.5, volatility_hysteresis: float = 0.5
) -> DataFrame:
    """(key, open_time_ms, direction, volatility, state, occurrence, start_ms, trend_deviation, late, again) of a stream of bars with open_time_ms and close.

    A row is given out once the watermark (the latest time less `delay`, over all keys) has passed it. Rules, ratios and their thresholds are those of
    `operators.states.direction` and `volatility`; start_ms is the occurrence's first time; trend_deviation is null where fewer than two errors are known.
    A row not above the last time given out of its key comes too late: it changes nothing and is counted in `late`, as are rows of an open already given
    out. Of rows that wait for the same key and open the largest (close, probability, ratios) counts, the others go to `again`. Rows without a time
    or a close above 0 are no bars and are left out; a null probability or ratio decides nothing. A null key is a key. The session must
    keep its state in RocksDB (`stored_in_rocksdb`)."""
    told = lambda c: F.when(F.isnan(c), F.lit(math.inf)).otherwise(F.col(c).cast("double"))  # noqa: E731  NaN is above all numbers in Spark
    rows = bars.where("open_time_ms IS NOT NULL AND close > 0 AND NOT isnan(close) AND close < double('infinity')")
    rows = rows.withColumn("_at", F.timestamp_millis("open_time_ms")).withWatermark("_at", delay)
    values = [told(c).alias(f"r{i}") for i, c in enumerate(ratios)]
    # without _at itself, Spark drops no late row before it is counted
    plain = rows.select(F.col(key).alias("key"), F.col("open_time_ms").alias("time_ms"), F.col("close").cast("double").alias("close"), told(probability).alias("p"), *values)
    plain = plain.fillna({f"r{i}": -math.inf for i in range(len(ratios))} | {"p": math.nan})
    type_ = bars.schema[key].dataType.simpleString()
    made = _States(type_, entry, list(ratios.values()), (direction_hysteresis, volatility_hysteresis))
    found = plain.groupBy("key").transformWithStateInPandas(made, f"key {type_}, {OUT}", "Append", "EventTime")
    known = F.when(~F.isnan("trend_deviation"), F.col("trend_deviation"))
    return found.withColumn("trend_deviation", known).withColumnRenamed("key", key)


@contextlib.contextmanager
def stored_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, as keyed state with timers needs; the setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_states(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing streamed states as Parquet: all that is there now; starting again from the checkpoint goes on where the last run ended."""
    with stored_in_rocksdb(found.sparkSession):
        return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
