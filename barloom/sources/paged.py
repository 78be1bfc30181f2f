"""Bars pulled page by page from an endpoint, as a data source of Spark: ranges of time are partitions, pages within one follow a cursor.

    spark.dataSource.register(PagedBars)
    spark.read.format("paged_bars").options(client="barloom.sources.paged:folder_client", path=..., symbols="a,b", start=..., end=...).load()

A client is named as module:factory; the factory gets the options and returns an object with ``fetch(symbol, since, limit)``, rows (timestamp, open, high, low,
close, volume) from ``since`` on, in order, ``limit`` at most, and ``latest()``, the time up to which there are bars. Times are epoch milliseconds. A fetch that raises ``Throttled``
or ``Unreachable`` is tried again after 1, 2, 4 ... times ``wait`` seconds, up to ``retries`` times; then the task fails and Spark runs its
range again elsewhere, or, with ``give_up`` true, the range ends there. Other errors aren't retried.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, timestamp bigint, open double, high double, low double, close double, volume double"


class Throttled(Exception):
    """Too many requests: wait and try again."""


class Unreachable(Exception):
    """The network failed: try again."""


class Client(Protocol):
    def fetch(self, symbol: str, since: int, limit: int) -> list[tuple]: ...

    def latest(self) -> int: ...


@dataclass
class Range(InputPartition):
    symbol: str
    start: int
    end: int


def retried(fetch, retries: int, wait: float, sleep=time.sleep):
    """What ``fetch`` returns, tried ``retries`` times at most; the pauses double. None if it never worked."""
    for attempt in range(retries):
        try:
            return fetch()
        except (Throttled, Unreachable):
            sleep(wait * 2**attempt)
    return None


def pages(client: Client, part: Range, limit: int, step: int, retries: int, wait: float, give_up: bool, sleep=time.sleep) -> Iterator[tuple]:
    """The rows of a range: each page begins after the last bar of the one before."""
    since = part.start
    while since < part.end:
        page = retried(lambda: client.fetch(part.symbol, since, limit), retries, wait, sleep)  # noqa: B023
        if page is None:
            if give_up:
                return
            raise Unreachable(f"{part.symbol} from {since}: {retries} attempts failed")
        if not page:
            return
        for at, *values in page:
            if at >= part.end:
                return
            yield (part.symbol, int(at), *(None if v is None else float(v) for v in values))
        since = int(page[-1][0]) + step


class PagedBars(DataSource):
    """Options: client, symbols (with commas between), start and end (milliseconds; end as far as there are bars unless given; ``last_bars`` sets start from it), step (of a bar, 60000),
    page (rows, 1000), pages (in a partition, 10), retries (5), wait (seconds, 1), give_up (false), and whatever the client wants."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Pull:
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        number = lambda name, usual: float(options.get(name, usual))
        self.step, self.page, self.each, self.retries, self.wait = int(number("step", 60_000)), int(number("page", 1000)), int(number("pages", 10)), int(number("retries", 5)), number("wait", 1)
        self.give_up = str(options.get("give_up", "false")).lower() == "true"
        self.symbols = [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]
        if min(self.step, self.page, self.each, self.retries) < 1:
            raise ValueError("step, page, pages and retries are at least 1")

    def client(self) -> Client:
        module, _, factory = self.options.get("client", "").partition(":")
        if not factory:
            raise ValueError("client is named as module:factory")
        return getattr(importlib.import_module(module), factory)(self.options)

    def end(self) -> int:
        latest = self.client().latest()
        return min(latest, int(self.options["end"])) if "end" in self.options else latest

    def start(self, end: int) -> int:
        return end - int(self.options["last_bars"]) * self.step if "last_bars" in self.options else int(self.options.get("start", 0))

    def ranges(self, start: int, end: int) -> list[Range]:
        width = self.step * self.page * self.each
        return [Range(s, a, min(end, a + width)) for s in self.symbols for a in range(start, end, width)]

    def rows(self, part: Range) -> Iterator[tuple]:
        return pages(self.client(), part, self.page, self.step, self.retries, self.wait, self.give_up)


class _Reader(_Pull, DataSourceReader):
    def partitions(self) -> list[Range]:
        end = self.end()
        return self.ranges(self.start(end), end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


class _StreamReader(_Pull, DataSourceStreamReader):
    """Each micro-batch pulls from where the last one ended up to the endpoint's latest bar."""

    def initialOffset(self) -> dict:
        return {"at": self.start(self.end())}

    def latestOffset(self) -> dict:
        return {"at": self.end()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start["at"], end["at"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


class FolderClient:
    """An endpoint made of Parquet files of (symbol, timestamp, prices, volume), for trials without a network. ``fail_every`` n: the first one to three attempts at about one page in n fail."""

    def __init__(self, options: Mapping[str, str]):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(options["path"])
        self.fail_every, self.tries = int(options.get("fail_every", 0)), {}

    def _rows(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, filesystem=self.store, format="parquet", exclude_invalid_files=True)

    def fetch(self, symbol: str, since: int, limit: int) -> list[tuple]:
        import pyarrow.dataset as ds

        tried = self.tries[symbol, since] = self.tries.get((symbol, since), 0) + 1
        kind = (since // 60_000 + sum(map(ord, symbol))) if self.fail_every else 1
        if self.fail_every and kind % self.fail_every == 0 and tried <= 1 + kind // self.fail_every % 3:
            raise Throttled(symbol) if kind % 2 else Unreachable(symbol)
        found = self._rows().to_table(filter=(ds.field("symbol") == symbol) & (ds.field("timestamp") >= since), columns=["timestamp", "open", "high", "low", "close", "volume"])
        found = found.sort_by("timestamp").slice(0, limit)
        return list(zip(*(c.to_pylist() for c in found.columns), strict=True))

    def latest(self) -> int:
        import pyarrow.compute as pc

        last = pc.max(self._rows().to_table(columns=["timestamp"])["timestamp"]).as_py()
        return 0 if last is None else last + 1


def folder_client(options: Mapping[str, str]) -> FolderClient:
    return FolderClient(options)
