"""Missing bars of running streams: full grids and full sessions, filled as the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.bars import KEYS, MISSING, ORDER, PRESENT, PRICES, interval
from barloom.operators.buckets import seconds
from barloom.streaming.ordered import AT, BATCH_ROWS, Ordered, frames, in_state, timed

_BAR = {**dict.fromkeys(PRICES, "double"), "volume": "double"}
_OUT = [AT, *_BAR, "features_mask", "features_reason"]
_SCHEMA = f"symbol string, timeframe string, {AT} long, {', '.join(f'{c} {k}' for c, k in _BAR.items())}, features_mask boolean, features_reason tinyint"


def _marks(close: float | None, volume: float | None) -> tuple[bool, int]:
    return close is not None and (volume or 0.0) > 0, MISSING if close is None else PRESENT


class Grid(Ordered):
    """State besides what waits: the last grid bar given out and the prices it carries on. A timer at each next bar makes those that don't come."""

    def __init__(self, step: int, forget: int):
        super().__init__(_BAR, forget)
        self.step = step * 1_000_000

    def init(self, handle):
        super().init(handle)
        self.carried = handle.getValueState("carried", f"at long, {', '.join(f'{c} double' for c in PRICES)}")

    def release(self, key, bars, passed) -> Iterator[pd.DataFrame]:
        if not bars and not self.carried.exists():
            return
        at, *prices = self.carried.get() if self.carried.exists() else (bars[0][0] - self.step, *[None] * len(PRICES))
        found = {}
        for bar in bars:
            found.setdefault(bar[0], bar)
        # bars end where the watermark is, or where the series is about to be forgotten
        last = bars[-1][0] if bars else self.seen.get()[0]
        end, out = min(passed, last + self.forget), []
        while at + self.step <= end:
            at += self.step
            own = found.get(at, (at, *[None] * len(_BAR)))
            prices = [x if x is not None else y for x, y in zip(own[1:5], prices, strict=True)]
            out.append((at, *(0.0 if x is None else x for x in prices), own[5] or 0.0, *_marks(own[4], own[5])))
            if len(out) == BATCH_ROWS:
                yield from frames(key, out, _OUT)
                out = []
        yield from frames(key, out, _OUT)
        self.carried.update((at, *prices))
        if at + self.step <= last + self.forget:
            self._timer(at + self.step)

    def forgotten(self):
        self.carried.clear()


def live_grid(bars: DataFrame, timeframe: str, lateness: str = "5 minutes", forget: str = "30 days") -> DataFrame:
    """Every bar from a symbol's first one up to the watermark, as ``bars.fill_grid`` makes them up to its last.

    A missing bar appears when the watermark passes its time, whether or not another follows. Series without bars for ``forget`` end there.
    Start the stream within ``ordered.state_store``.
    """
    rows, _ = in_state(bars.select(*KEYS, ORDER, *_BAR), lateness)
    return timed(rows.groupBy(*KEYS).transformWithStateInPandas(Grid(seconds(interval(timeframe)), seconds(forget)), _SCHEMA, "Append", "eventTime"), bars)


class Sessions(Ordered):
    """Bars wait for the end of their local date's session. State besides them: the last close, and the last date given out."""

    def __init__(self, zone: str, opens: str, last: str, step: int, forget: int):
        super().__init__(_BAR, forget)
        self.zone, self.opens, self.last, self.step = zone, opens, last, step

    def init(self, handle):
        super().init(handle)
        self.held = handle.getValueState("held", "close double, day string")

    def _utc(self, day, clock: str) -> int:
        local = datetime.combine(day, time.fromisoformat(clock), tzinfo=ZoneInfo(self.zone))
        return round(local.timestamp()) * 1_000_000

    def _day(self, at: int):
        return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at)).astimezone(ZoneInfo(self.zone)).date()

    def due(self, at):
        return max(at, self._utc(self._day(at), self.last))

    def release(self, key, bars, passed) -> Iterator[pd.DataFrame]:
        if not bars:
            return
        close, done = self.held.get() if self.held.exists() else (None, "")
        days: dict[object, dict[int, tuple]] = {}
        for bar in bars:
            days.setdefault(self._day(bar[0]), {}).setdefault(bar[0], bar)
        for day, found in days.items():
            if day.isoformat() <= done:
                continue  # a bar after the session of a date that is out already
            out, done = [], day.isoformat()
            for at in range(self._utc(day, self.opens), self._utc(day, self.last) + 1, self.step * 1_000_000):
                own = found.get(at, (at, *[None] * len(_BAR)))
                close = own[4] if own[4] is not None else close
                if close is not None:
                    out.append((at, *(close if x is None else x for x in own[1:4]), close, own[5] or 0.0, *_marks(own[4], own[5])))
            yield from frames(key, out, _OUT)
        self.held.update((close, done))

    def forgotten(self):
        self.held.clear()


def live_sessions(bars: DataFrame, zone: str = "Asia/Taipei", opens: str = "09:00:00", last: str = "13:15:00", timeframe: str = "15m", lateness: str = "5 minutes", forget: str = "60 days") -> DataFrame:
    """A full grid for each local date with bars, as ``bars.fill_sessions`` makes it, once the watermark has passed the date's last bar.

    Start the stream within ``ordered.state_store``.
    """
    rows, _ = in_state(bars.select(*KEYS, ORDER, *_BAR), lateness)
    return timed(rows.groupBy(*KEYS).transformWithStateInPandas(Sessions(zone, opens, last, seconds(interval(timeframe)), seconds(forget)), _SCHEMA, "Append", "eventTime"), bars)
