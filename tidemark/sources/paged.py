"""A source of bars behind a paged call, such as an exchange's, as a table or as a stream.

The range is cut into slices of time, one partition each; within a slice a cursor moves past the last row until a page
is short. What calls the network is given by name, so the library has no network code of its own:
`fetch(symbol, interval, start_ms, end_ms, limit)` gives rows [open_time, open, high, low, close, volume].

As a stream, an offset is the open that each symbol is to be asked for next. `latest(symbol, interval)`, given by name too, tells a
symbol's last finished open; a batch holds what lies between. Offsets are in the checkpoint, so a stream that is started again goes on where it
was, and a batch that is run again asks for the same range.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator
from functools import partial

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BARS = "symbol string, open_time_ms bigint, open double, high double, low double, close double, volume double"


class Slice(InputPartition):
    def __init__(self, symbol: str, start_ms: int, end_ms: int):
        self.symbol, self.start_ms, self.end_ms = symbol, start_ms, end_ms


def named(path: str):
    """The function that `module:name` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class Pages:
    """What both readers share: options, slices of time, and pages with another try after an OSError."""

    def __init__(self, options: dict[str, str]):
        self.symbols = [s.strip().upper() for s in options["symbol"].split(",")]
        self.interval = options.get("interval", "1d")
        self.start = int(options["start_ms"])
        self.step = int(options.get("step_ms", 86_400_000))
        self.limit = int(options.get("limit", 1000))
        self.slices = int(options.get("slices", 8))
        self.attempts = int(options.get("attempts", 3))
        self.wait = float(options.get("wait_s", 1.2))
        self.fetch = options["fetch"]
        if options.get("table"):
            self.fetch = f"{self.fetch}@{options['table']}"

    def cut(self, symbol: str, start: int, end: int) -> list[Slice]:
        whole = (end - start) // self.step + 1
        size = max(1, -(-whole // self.slices)) * self.step
        return [Slice(symbol, a, min(a + size - 1, end)) for a in range(start, end + 1, size)]

    def tried(self, call, *args):
        for attempt in range(self.attempts):
            try:
                return call(*args)
            except OSError:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(self.wait)
        return None

    def read(self, partition: Slice) -> Iterator[tuple]:
        name, _, table = self.fetch.partition("@")
        call = partial(named(name), table) if table else named(name)
        cursor = partition.start_ms
        while cursor <= partition.end_ms:
            page = self.tried(call, partition.symbol, self.interval, cursor, partition.end_ms, self.limit)
            for row in page:
                yield (partition.symbol, int(row[0]), *[float(x) for x in row[1:6]])
            if len(page) < self.limit:
                return
            cursor = int(page[-1][0]) + self.step


class PagedReader(Pages, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        Pages.__init__(self, options)
        self.end = int(options["end_ms"])

    def partitions(self) -> list[Slice]:
        return [s for symbol in self.symbols for s in self.cut(symbol, self.start, self.end)]


class PagedStreamReader(Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        Pages.__init__(self, options)
        self.latest, self.table = options["latest"], options.get("table")

    def initialOffset(self) -> dict:
        return {s: self.start for s in self.symbols}

    def latestOffset(self) -> dict:
        call = partial(named(self.latest), self.table) if self.table else named(self.latest)
        found = {s: self.tried(call, s, self.interval) for s in self.symbols}
        return {s: self.start if x is None else max(self.start, int(x) + self.step) for s, x in found.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        # a symbol that was not asked for before starts at the beginning; a source that went back asks for nothing
        return [x for s in self.symbols if start.get(s, self.start) < end[s] for x in self.cut(s, start.get(s, self.start), end[s] - 1)]


class PagedBars(DataSource):
    """Format `paged_bars`; options symbol (several: comma-joined), start_ms, fetch, end_ms for a table or `latest` for a stream, and interval,
    step_ms, limit, slices, attempts, wait_s. With `table`, that is the first argument of both functions."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(dict(self.options))


def _stored(table: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(table)
    return ds.dataset(path, filesystem=store, format="parquet")


def stored_pages(table: str, symbol: str, interval: str, start_ms: int, end_ms: int, limit: int) -> list[list]:
    """Pages of a Parquet table of bars (symbol and the columns of BARS): the first `limit` rows of a range."""
    import pyarrow.compute as pc

    at = pc.field("open_time_ms")
    found = _stored(table).to_table(filter=(pc.field("symbol") == symbol) & (at >= start_ms) & (at <= end_ms)).sort_by("open_time_ms").slice(0, limit)
    return [[r["open_time_ms"], r["open"], r["high"], r["low"], r["close"], r["volume"]] for r in found.to_pylist()]


def stored_latest(table: str, symbol: str, interval: str) -> int | None:
    """The last open of a symbol in such a table."""
    import pyarrow.compute as pc

    return pc.max(_stored(table).to_table(columns=["open_time_ms"], filter=pc.field("symbol") == symbol)["open_time_ms"]).as_py()


def sawtooth(symbol: str, interval: str, start_ms: int, end_ms: int, limit: int) -> list[list]:
    """A made-up source for tests: one bar a day whose prices follow from the day's number."""
    day = 86_400_000
    first = -(-start_ms // day)
    rows = []
    for k in range(first, min(end_ms // day, first + limit - 1) + 1):
        c = 100 + k % 17
        rows.append([k * day, str(c - 1), str(c + 2), str(c - 3), str(c), str(k % 5)])
    return rows
