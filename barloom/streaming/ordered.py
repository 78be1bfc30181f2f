"""Bars of a stream in order: each waits in state until the watermark has passed it.

A processor gets the bars of one series. They stay in list state until no earlier bar can come; a timer at the earliest of them
then releases all that are due, in order, whichever micro-batches they came in. Bars that come after the watermark has passed them are dropped, as Spark does. A series without
bars for ``forget`` of event time is forgotten, and begins anew with its next bar. Times are kept as microseconds, whatever the session's zone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.bars import KEYS, ORDER

AT, BATCH_ROWS = "at_micros", 10_000  # names of inputs must not begin with an underscore
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which timers and lists need; the session's setting stays as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def rows_of(pdf: pd.DataFrame, columns: Iterable[str]) -> list[tuple]:
    """Rows as tuples of plain values, None for what is missing."""
    part = pdf[list(columns)].astype(object)
    return list(part.where(part.notna(), None).itertuples(index=False, name=None))


class Ordered(StatefulProcessor):
    """``release`` gets the due bars of a series, in order: tuples of the time in microseconds and ``columns``."""

    def __init__(self, columns: dict[str, str], forget: int):
        self.columns, self.forget = columns, forget * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"at long, {', '.join(f'{c} {k}' for c, k in self.columns.items())}")
        self.seen = handle.getValueState("seen", "at long")  # the last bar released

    def due(self, at: int) -> int:
        """When the watermark has reached this, the bar is released."""
        return at

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [r for pdf in rows for r in rows_of(pdf, [AT, *self.columns])]
        if found:
            self.pending.appendList(found)
            self._timer(min(self.due(r[0]) for r in found))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.pending.get()) if self.pending.exists() else []
        ready = sorted((r for r in waiting if self.due(r[0]) <= passed), key=lambda r: r[0])
        if ready:
            waiting = [r for r in waiting if self.due(r[0]) > passed]
            self.pending.put(waiting) if waiting else self.pending.clear()
        last = self.seen.get()[0] if self.seen.exists() else None
        own: list[tuple] = []
        for bar in ready:
            if last is not None and bar[0] > last + self.forget:  # the same whether the bar comes before or after the silence is noticed
                yield from self.release(key, own, last + self.forget)
                self.anew()
                own = []
            own.append(bar)
            last = bar[0]
        yield from self.release(key, own, passed)
        if ready:
            self.seen.update((last,))
        if waiting:
            self._timer(min(self.due(r[0]) for r in waiting))
        elif last is not None and passed >= last + self.forget:
            self.pending.clear()
            self.seen.clear()
            self.forgotten()
        elif last is not None:
            self._timer(last + self.forget)

    def release(self, key: tuple, bars: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def forgotten(self) -> None:
        """Clears what a subclass keeps."""

    def anew(self) -> None:
        """The series was silent for too long; what is released next begins it anew."""
        self.forgotten()

    def close(self) -> None:
        pass


def in_state(bars: DataFrame, lateness: str) -> tuple[DataFrame, dict[str, str]]:
    """Bars with a watermark and their time in microseconds; the other columns and their types. Times without a zone are read in the session's."""
    columns = {f.name: f.dataType.simpleString() for f in bars.schema if f.name not in (*KEYS, ORDER)}
    rows = bars.where(F.col(ORDER).isNotNull()).withColumn(ORDER, F.col(ORDER).cast("timestamp")).withWatermark(ORDER, lateness)
    return rows.withColumn(AT, F.unix_micros(ORDER)), columns


def timed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """With times in place of microseconds, of the type they have in ``like``."""
    at = F.timestamp_micros(AT).cast(like.schema[ORDER].dataType).alias(ORDER)
    return rows.select(*KEYS, at, *(c for c in rows.columns if c not in (*KEYS, AT)))


def frames(key: tuple, rows: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of a series as data frames of bounded size."""
    for i in range(0, len(rows), BATCH_ROWS):
        pdf = pd.DataFrame.from_records(rows[i : i + BATCH_ROWS], columns=names)
        for k, v in zip(reversed(KEYS), reversed(key[: len(KEYS)]), strict=True):
            pdf.insert(0, k, v)
        yield pdf


