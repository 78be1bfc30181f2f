"""Bars and indicators of running streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import KEYS, ORDER, PRICES, interval, with_close_time
from barloom.operators.buckets import seconds
from barloom.streaming.ordered import AT, Ordered, frames, in_state, timed


def live_bars(ticks: DataFrame, timeframe: str, symbol: str, at: str, price: str, tie: str, lateness: str = "5 minutes") -> DataFrame:
    """Closed bars only: each appears once the watermark has passed its end. Ticks later than ``lateness`` are dropped.

    Watermarks need times with a zone: times without one are read in the session's, and given back without.
    """
    order, kind = F.struct(at, tie), ticks.schema[at].dataType.simpleString()
    rows = ticks.where(F.col(at).isNotNull() & F.col(price).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    bars = rows.groupBy(F.col(symbol).alias("symbol"), F.window(at, interval(timeframe)).alias("bar")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return with_close_time(bars.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bar.start").cast(kind).alias(ORDER), *PRICES, "volume"), timeframe)


class Strength(Ordered):
    """The strength index bar by bar; of a series, four numbers are kept."""

    def __init__(self, period: int, forget: int):
        super().__init__({"close": "double"}, forget)
        self.period = period

    def init(self, handle):
        super().init(handle)
        self.moves = handle.getValueState("moves", "last double, gain double, loss double, seen long")

    def release(self, key, bars, passed) -> Iterator[pd.DataFrame]:
        if not bars:
            return
        last, gain, loss, seen = self.moves.get() if self.moves.exists() else (None, 0.0, 0.0, 0)
        out, a = [], 1.0 / self.period
        for at, close in bars:
            move = 0.0 if last is None or close is None else close - last
            up, down = max(move, 0.0), max(-move, 0.0)
            gain, loss = (up, down) if seen == 0 else (gain + a * (up - gain), loss + a * (down - loss))
            seen += 1
            last = close if close is not None else last
            out.append((at, close, 100.0 - 100.0 / (1.0 + gain / (loss + 1e-9))))
        self.moves.update((last, gain, loss, seen))
        yield from frames(key, out, [AT, "close", "rsi"])

    def forgotten(self):
        self.moves.clear()


def live_rsi(bars: DataFrame, period: int = 14, lateness: str = "0 seconds", forget: str = "90 days") -> DataFrame:
    """The strength index of each bar that the watermark has passed, in order whatever micro-batch it came in: the batch value on the same bars.

    Series without bars for ``forget`` begin anew. Start the stream within ``ordered.state_store``.
    """
    if period < 1:
        raise ValueError("a period is at least 1")
    rows, _ = in_state(bars.select(*KEYS, ORDER, "close"), lateness)
    return timed(rows.groupBy(*KEYS).transformWithStateInPandas(Strength(period, seconds(forget)), f"symbol string, timeframe string, {AT} long, close double, rsi double", "Append", "eventTime"), bars)


def live_freeze(matrix: Column, open_: Column, states: int) -> Column:
    """One step of a stream frozen where the market is closed."""
    from barloom.operators.transitions import frozen

    return frozen(matrix, open_, states)
