"""What the query modules share: a registry, the SQL of the bar relations, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400_000
BO = f"""bo AS (SELECT (epoch_ms(o_orderdate) // {DAY}) * {DAY} AS open_time_ms, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1)"""


def be(step: int = DAY) -> str:
    return f"""be AS (SELECT event_type, (epoch_us(ts) // {step * 1000}) * {step} AS open_time_ms, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""


HOUR = 3_600_000
BE, BEH = be(), be(HOUR)


def lr(a: str, b: str) -> str:
    """SQL: ln(a / b) of positive prices, else null."""
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"


#: Bars whose prices are all positive.
PRICED = "least(open, high, low, close) > 0"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0 made 0, so that the order of summation does not show."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


class Book:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put


__all__ = ["BE", "BEH", "BO", "DAY", "HOUR", "Book", "Column", "DataFrame", "F", "SparkSession", "PRICED", "be", "lr", "rounded"]
