"""Prices of the running session of a stream: state by symbol and date, gone when the watermark has passed the date."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barloom.functions import sql as s
from barloom.functions.rolling import value_area
from barloom.operators.bars import KEYS, ORDER
from barloom.operators.indicators.profile import BINS, SHARE
from barloom.streaming.ordered import AT, Ordered, frames, in_state, rows_of, timed

_DAY = 86_400
_TOTALS = ["total_volume", "total_price", "total_square"]


class Totals(Ordered):
    """Running sums of volume, volume times price and volume times squared price of a date's bars, in order."""

    def __init__(self):
        super().__init__(dict.fromkeys(("close", "volume", "price", "square"), "double"), 0)

    def init(self, handle):
        super().init(handle)
        self.totals = handle.getValueState("totals", ", ".join(f"{t} double" for t in _TOTALS))

    def release(self, key, bars, passed) -> Iterator[pd.DataFrame]:
        totals, out = list(self.totals.get()) if self.totals.exists() else [0.0] * 3, []
        for at, close, volume, price, square in bars:
            for i, x in enumerate((volume, None if price is None or volume is None else price * volume, None if square is None or volume is None else square * volume)):
                totals[i] += x or 0.0
            out.append((at, close, *totals))
        yield from frames(key, out, [AT, "close", *_TOTALS])
        if passed >= (key[2] + 1) * _DAY * 1_000_000:
            self.totals.clear()
        elif bars:
            self.totals.update(tuple(totals))
            self._timer((key[2] + 1) * _DAY * 1_000_000)


def live_vwap(bars: DataFrame, stds: tuple[float, ...] = (1.0, 1.5, 2.0), lateness: str = "5 minutes") -> DataFrame:
    """Average price by volume since midnight, its deviation, and bands around it, for each bar that the watermark has passed.

    Start the stream within ``ordered.state_store``.
    """
    price = "(high + low + close) / 3e0"
    rows, _ = in_state(bars.select(*KEYS, ORDER, "close", "volume", F.expr(price).alias("price"), F.expr(s.bounded_pow(price, 2)).alias("square")), lateness)
    day = F.floor(F.col(AT) / F.lit(_DAY * 1_000_000)).cast("long")
    sums = rows.withColumn("day_number", day).groupBy(*KEYS, "day_number").transformWithStateInPandas(Totals(), f"symbol string, timeframe string, {AT} long, close double, {', '.join(f'{t} double' for t in _TOTALS)}", "Append", "eventTime")
    out = timed(sums, bars).withColumn("VWAP", F.expr(s.fill(s.guarded("total_price", "total_volume"))))
    out = out.withColumn("StdDev", F.expr(s.safe_sqrt(f"{s.fill(s.guarded('total_square', 'total_volume'))} - {s.bounded_pow('VWAP', 2)}")))
    bands = [F.expr(f"VWAP {sign} {s.num(k)} * StdDev").alias(f"{side}{i}") for i, k in enumerate(stds, 1) for side, sign in (("Upper", "+"), ("Lower", "-"))]
    return out.select(*KEYS, ORDER, "close", "VWAP", "StdDev", *bands)


class Profile(StatefulProcessor):
    """Volume by range of prices, in map state, and the date's lowest and highest price; a timer at the date's end makes the profile."""

    def __init__(self, bins: int, share: float):
        self.bins, self.share = bins, share

    def init(self, handle) -> None:
        self.handle = handle
        self.volumes = handle.getMapState("volumes", "low double, high double", "volume double")
        self.ends = handle.getValueState("ends", "bottom double, top double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bottom, top = self.ends.get() if self.ends.exists() else (None, None)
        for pdf in rows:
            for high, low, volume in rows_of(pdf, ["high", "low", "volume"]):
                bottom = low if bottom is None else bottom if low is None else min(bottom, low)
                top = high if top is None else top if high is None else max(top, high)
                if volume:
                    place = (-math.inf if low is None else low, math.inf if high is None else high)  # without an end, a bar reaches to the date's
                    before = self.volumes.getValue(place)[0] if self.volumes.containsKey(place) else 0.0
                    self.volumes.updateValue(place, (before + volume,))
        self.ends.update((bottom, top))
        self.handle.registerTimer((key[2] + 1) * _DAY * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ends.exists():
            return
        bottom, top = self.ends.get()
        placed = [(*place, value[0]) for place, value in self.volumes.iterator()]
        yield pd.DataFrame({"symbol": [key[0]], "timeframe": [key[1]], "session": [key[2]], **{n: [v] for n, v in zip(("poc", "vah", "val"), self._levels(bottom, top, placed), strict=True)}})
        self.volumes.clear()
        self.ends.clear()

    def _levels(self, bottom: float | None, top: float | None, placed: list[tuple]) -> tuple:
        if bottom is None or top is None:
            return None, top, bottom
        if placed and top - bottom >= 1e-9:
            size = (top - bottom) / self.bins
            low, high, volume = (np.array(x) for x in zip(*placed, strict=True))
            first, last = np.maximum(0, np.trunc((low - bottom) / size)), np.minimum(self.bins - 1, np.trunc((high - bottom) / size))
            profile = np.zeros(self.bins)
            for i, j, x in zip(first.astype(int).tolist(), last.astype(int).tolist(), volume.tolist(), strict=True):
                if j >= i:  # a bar at the very top may touch no bin
                    profile[i : j + 1] += x / (j - i + 1)
            if profile.sum() >= 1e-9:
                peak, lower, upper = value_area(profile, self.share)
                return tuple(bottom + i * size + size / 2 for i in (peak, upper, lower))
        return (bottom + top) / 2, top, bottom

    def close(self) -> None:
        pass


def live_profiles(bars: DataFrame, bins: int = BINS, share: float = SHARE, lateness: str = "5 minutes") -> DataFrame:
    """One row for each symbol and date once the watermark has passed it: price of most volume, and the bounds of the area with ``share`` of the volume around it.

    Bars of one price range are kept together, so that state grows with the ranges that occur in a day. Start the stream within ``ordered.state_store``.
    """
    rows, _ = in_state(bars.select(*KEYS, ORDER, "high", "low", "volume"), lateness)
    day = F.floor(F.col(AT) / F.lit(_DAY * 1_000_000)).cast("long")
    out = rows.withColumn("day_number", day).groupBy(*KEYS, "day_number").transformWithStateInPandas(Profile(bins, share), "symbol string, timeframe string, session long, poc double, vah double, val double", "Append", "eventTime")
    return out.withColumn("session", F.date_from_unix_date(F.col("session").cast("int")))
