"""Recurrences along ordered series: what a window frame can't express.

``scan_series`` deals the series out by key, sorts each once and runs over the Arrow batches of every partition, with
the state of each recurrence carried from batch to batch. A task keeps one batch and a few numbers, however long a
series is. Each kind also states its step as SQL, which the tests and the oracle run as a recursive query.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

KEYS, ORDER = ("symbol", "timeframe"), "datetime"


def leaky_sum(x: np.ndarray, keep: float, carry: float) -> np.ndarray:
    """s[t] = keep * s[t - 1] + x[t], with s[-1] = carry."""
    fresh = 1.0 - keep
    padded = np.concatenate(([carry * fresh], x))
    return pd.Series(padded).ewm(alpha=fresh, adjust=False).mean().to_numpy()[1:] / fresh


@dataclass(frozen=True)
class Recurrence:
    """Inputs are names of double columns. ``run`` returns the outputs and the state after the last row."""

    inputs: tuple[str, ...]
    params: tuple[float, ...]
    outputs: int = field(default=1, init=False)

    @property
    def reach(self) -> int | None:
        """Rows before a row that its outputs depend on, where nothing older matters; None: all of them do."""
        return None

    def run(self, state, *xs: np.ndarray): ...

    def summary(self, *xs: np.ndarray) -> list[float]:
        """What a block of rows does to any state, in numbers, so that blocks can be summed up apart from each other."""
        raise NotImplementedError

    def after(self, state, summary: list[float]):
        """The state after a block, from the state before it and the block's summary: what ``run`` would return."""
        raise NotImplementedError

    def packed(self, state) -> list[float]:
        return [] if state is None or state[0] is None else [float(x) for x in state]

    def unpacked(self, numbers: list[float]):
        return tuple(numbers) if len(numbers) else None

    def sql(self, at: str) -> tuple[dict[str, tuple[str, str]], list[str]]:
        """Of each state column: first value and next value (p: the state before, n: this row). Of each output: its value from n and e, the state after."""
        raise NotImplementedError


class Smoothed(Recurrence):
    """y = (1 - a) * y + a * x, seeded with the first value. Nulls stay null; the weight of what came before fades over them."""

    def run(self, state, x):
        a = self.params[0]
        y, gap = state or (None, 0)
        out = np.full(len(x), np.nan)
        seen = ~np.isnan(x)
        if not seen.any():
            return (out,), (y, gap + len(x)) if y is not None else None
        first = 0 if y is not None and gap == 0 else int(np.argmax(seen))
        if seen[first:].all() and (y is None or (gap == 0 and first == 0)):
            # the mean as pandas takes it stays exactly where a series stands still
            padded = pd.Series(np.concatenate(([x[first] if y is None else y], x[first:])))
            out[first:] = padded.ewm(alpha=a, adjust=False).mean().to_numpy()[1:]
            return (out,), (float(out[-1]), 0)
        for i in range(len(x)):
            if not seen[i]:
                gap += y is not None
                continue
            old = (1 - a) ** (gap + 1)
            y = x[i] if y is None or y == x[i] else (old * y + a * x[i]) / (old + a)
            gap, out[i] = 0, y
        return (out,), (float(y), gap)

    def summary(self, x):
        """Rows before the first value, that value, the mean at the end of a series that begins with it, how much of a difference at the first value is left at the end, rows after the last value."""
        a, seen = self.params[0], np.flatnonzero(~np.isnan(x))
        if not len(seen):
            return [len(x), np.nan, np.nan, 1.0, 0]
        _, (end, gap) = self.run(None, x[seen[0] :])
        old = (1 - a) ** np.diff(seen).astype(float)
        return [int(seen[0]), x[seen[0]], end, float(np.prod(old / (old + a))), gap]

    def after(self, state, summary):
        lead, first, end, left, trail = summary
        if math.isnan(first):
            return (state[0], state[1] + lead) if state else None
        y = first
        if state and state[0] != first:
            old = (1 - self.params[0]) ** (state[1] + lead + 1)
            y = (old * state[0] + self.params[0] * first) / (old + self.params[0])
        return (end + left * (y - first), trail)

    def sql(self, at):
        x, a = self.inputs[0], self.params[0]
        old = f"power({1 - a!r}, p.{at}g + 1)"
        y = f"CASE WHEN n.{x} IS NULL THEN p.{at}y WHEN p.{at}y IS NULL OR p.{at}y = n.{x} THEN n.{x} ELSE ({old} * p.{at}y + {a!r} * n.{x}) / ({old} + {a!r}) END"
        return {f"{at}y": (f"n.{x}", y), f"{at}g": ("0", f"CASE WHEN n.{x} IS NULL THEN p.{at}g + 1 ELSE 0 END")}, [f"CASE WHEN n.{x} IS NOT NULL THEN e.{at}y END"]


class Weighted(Recurrence):
    """The mean of all values so far with weights (1 - a) ** age. Nulls stay null; params: a, whether age counts them."""

    def run(self, state, x):
        a, counted = self.params
        total, weight = state or (0.0, 0.0)
        out = np.full(len(x), np.nan)
        seen = ~np.isnan(x)
        at = slice(None) if counted else np.flatnonzero(seen)
        value = np.nan_to_num(x)[at]
        if len(value):
            sums, weights = leaky_sum(value, 1 - a, total), leaky_sum(seen[at].astype(float), 1 - a, weight)
            ratio = np.divide(sums, weights, out=np.full(len(sums), np.nan), where=weights > 0)
            out[at] = ratio
            out[~seen] = np.nan
            total, weight = float(sums[-1]), float(weights[-1])
        return (out,), (total, weight)

    def summary(self, x):
        """Sum and weight of a series that begins here, and how much of an older sum is left."""
        a, counted = self.params
        _, (total, weight) = self.run(None, x)
        return [total, weight, (1 - a) ** (len(x) if counted else int((~np.isnan(x)).sum()))]

    def after(self, state, summary):
        total, weight = state or (0.0, 0.0)
        return (summary[0] + summary[2] * total, summary[1] + summary[2] * weight)

    def sql(self, at):
        x, (a, counted) = self.inputs[0], self.params
        keep = repr(1 - a)
        step = lambda s, v: f"{keep} * p.{at}{s} + {v}" if counted else f"CASE WHEN n.{x} IS NULL THEN p.{at}{s} ELSE {keep} * p.{at}{s} + {v} END"
        one = f"CASE WHEN n.{x} IS NULL THEN 0e0 ELSE 1e0 END"
        return {f"{at}s": (f"coalesce(n.{x}, 0e0)", step("s", f"coalesce(n.{x}, 0e0)")), f"{at}w": (one, step("w", one))}, [f"CASE WHEN n.{x} IS NOT NULL THEN e.{at}s / e.{at}w END"]


class Running(Recurrence):
    """Over all values so far: params[0] picks the sum, the largest, the least or the last. Null until there is a value."""

    SUM, MAX, MIN, LAST = range(4)

    def run(self, state, x):
        kind, seen = int(self.params[0]), ~np.isnan(x)
        began = np.maximum.accumulate(seen) if len(x) else seen
        if kind == self.LAST:
            last = np.maximum.accumulate(np.where(seen, np.arange(len(x)), -1)) if len(x) else np.zeros(0, dtype=int)
            out = x[last] if len(x) else x.copy()
        else:
            fold, empty = ((np.add, 0.0), (np.maximum, -np.inf), (np.minimum, np.inf))[kind]
            out = fold.accumulate(np.where(seen, x, empty))
            if state:
                out = fold(state[0], out)
        out = np.where(began, out, state[0] if state else np.nan)
        return (out,), (float(out[-1]),) if len(out) and not math.isnan(out[-1]) else state

    def summary(self, x):
        _, state = self.run(None, x)
        return list(state or ())

    def after(self, state, summary):
        if not state or not summary:
            return tuple(summary) or state
        (a,), (b,) = state, summary
        return ((a + b, max(a, b), min(a, b), b)[int(self.params[0])],)


class Kalman(Recurrence):
    """A filter of constant level: params are the noise of process and of measurement. Leading nulls stay null, later ones predict only."""

    def run(self, state, x):
        q, r = self.params
        level, p = state or (None, 1.0)
        out = np.full(len(x), np.nan)
        for i, z in enumerate(x.tolist()):
            if level is None:
                level = None if math.isnan(z) else z
            else:
                p += q
                if not math.isnan(z):
                    gain = p / (p + r)
                    level, p = level + gain * (z - level), (1 - gain) * p
            if level is not None:
                out[i] = level
        return (out,), (level, p)

    def _steps(self, x: list[float]) -> list[float]:
        """Rows as one step of a Gaussian filter: given the level before them, the one after is a * level + b with variance c; the rows' own word on the level before has precision j and points to e / j."""
        q, r = self.params
        a, b, c, e, j = 1.0, 0.0, 0.0, 0.0, 0.0
        gain, tells = q / (q + r), 1 / (q + r)
        for z in x:
            if math.isnan(z):
                c += q
                continue
            shrink = 1 / (1 + c * tells)
            e, j = e + a * shrink * tells * (z - b), j + a * a * shrink * tells
            a, b, c = (1 - gain) * shrink * a, (1 - gain) * shrink * (b + c * z * tells) + gain * z, (1 - gain) ** 2 * shrink * c + (1 - gain) * q
        return [a, b, c, e, j]

    def summary(self, x):
        """The first value, what follows it as one step, and all rows as one step."""
        seen = np.flatnonzero(~np.isnan(x))
        first = int(seen[0]) if len(seen) else len(x)
        return [x[first] if len(seen) else np.nan, *self._steps(x[first + 1 :].tolist()), *self._steps(x.tolist())]

    def after(self, state, summary):
        if state is None and math.isnan(summary[0]):
            return None
        level, p = state or (summary[0], 1.0)
        a, b, c, e, j = summary[6:] if state else summary[1:6]
        shrink = 1 / (1 + p * j)
        return (a * shrink * (level + p * e) + b, a * a * shrink * p + c)

    def sql(self, at):
        x, (q, r) = self.inputs[0], self.params
        p = f"(p.{at}p + {q!r})"
        level = f"CASE WHEN p.{at}x IS NULL THEN n.{x} WHEN n.{x} IS NULL THEN p.{at}x ELSE p.{at}x + {p} / ({p} + {r!r}) * (n.{x} - p.{at}x) END"
        return {f"{at}x": (f"n.{x}", level), f"{at}p": ("1e0", f"CASE WHEN p.{at}x IS NULL THEN p.{at}p WHEN n.{x} IS NULL THEN {p} ELSE (1e0 - {p} / ({p} + {r!r})) * {p} END")}, [f"e.{at}x"]


class Chase:
    """What rows do to a level that stays where it is while ``low[t] <= level < high[t]``, and is set anew by the row that ends that.

    Of the level before the rows, the level after them is a function of few pieces: between bounds at which another row is the first to set it anew, it either stays or ends where that row
    leads, and levels that different rows have set soon meet. ``step(t, level, side)`` is row t's work; ``bounds`` has low and high for each side, either NaN where no level stays, whatever decides how it is set anew among them; ``never`` is a level
    that doesn't stay anywhere.
    """

    def __init__(self, step, bounds: dict[float, tuple[np.ndarray, np.ndarray]], never: float = math.nan):
        self.step, self.never = step, never
        self.bounds = {side: (np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), -np.inf, high)) for side, (low, high) in bounds.items()}
        self.known: dict[tuple[int, float, float], tuple[float, float]] = {}

    def end(self, t: int, level: float, side: float) -> tuple[float, float]:
        """Level and side after all rows, from those after row t."""
        path = []
        while (t, level, side) not in self.known:
            path.append((t, level, side))
            low, high = self.bounds[side]
            at, width = t + 1, 16
            while at < len(low) and level != self.never:
                out = np.flatnonzero(~((low[at : at + width] <= level) & (level < high[at : at + width])))
                if len(out):
                    at += int(out[0])
                    break
                at, width = at + width, width * 2
            if at >= len(low):
                self.known[t, level, side] = (level, side)
                break
            level, side = self.step(at, level, side)
            t = at
        found = self.known[t, level, side]
        self.known.update(dict.fromkeys(path, found))
        return found

    def first(self, level: float, side: float) -> tuple[float, float]:
        """Level and side after all rows, where the first row sets the level anew."""
        return self.end(0, *self.step(0, level, side))

    def pieces(self, side: float) -> list[float]:
        """Their number, and for each, from the lowest: the least level, whether it stays, else level and side after the rows."""
        low, high = (np.maximum.accumulate(self.bounds[side][0]), np.minimum.accumulate(self.bounds[side][1]))
        starts = np.unique(np.concatenate([[-np.inf], low, high]))
        starts = starts[starts < np.inf]
        ends = np.minimum(np.searchsorted(low, starts, side="right"), np.searchsorted(-high, -starts, side="left"))
        found: list[tuple[float, float, float, float]] = []
        for level, t in zip(starts.tolist(), ends.tolist(), strict=True):
            piece = (1.0, 0.0, side) if t == len(low) else (0.0, *self.end(t, *self.step(t, level, side)))
            if not found or not np.array_equal(found[-1][1:], piece, equal_nan=True):
                found.append((level, *piece))
        return [len(found), *(x for piece in found for x in piece)]


def _through(pieces: list[float], level: float, side: float) -> tuple[float, float]:
    """Where a level of this side ends."""
    at = pieces[4 * (bisect.bisect_right(pieces[::4], level) - 1) :][:4]
    return (level, side) if at[1] else (at[2], at[3])


def _parts(summary: list[float], at: int) -> tuple[list[float], int]:
    """The pieces that begin here, without their number, and where the next begin."""
    to = at + 1 + 4 * int(summary[at])
    return list(summary[at + 1 : to]), to


class Trailing(Recurrence):
    """Stops that only tighten while the close is beyond them. inputs: close, candidate below, candidate above.

    A stop that is 0 or null is unset, and the candidate takes its place; so it does without a close. Without a candidate there is no stop. Each side is on its own.
    """

    outputs = 2

    @staticmethod
    def _step(close: list[float], candidate: list[float]):
        def step(t, level, side):
            c, b = close[t], candidate[t]
            return (level if c > level != 0 and level > b else b), side

        return step

    def run(self, state, close, below, above):
        long, short = state or (0.0, 0.0)
        outs = np.full((2, len(close)), np.nan)
        up, down = self._step(close.tolist(), below.tolist()), self._step((-close).tolist(), (-above).tolist())
        short = -short
        for i in range(len(close)):
            outs[:, i] = long, short = up(i, long, 1.0)[0], down(i, short, 1.0)[0]
        outs[1] = -outs[1]
        return tuple(outs), (long, -short)

    def summary(self, close, below, above):
        """For each side, the one above mirrored: where an unset stop ends, and the pieces of what becomes of others."""
        found = []
        for c, b in ((close, below), (-close, -above)):
            if len(c):
                chase = Chase(self._step(c.tolist(), b.tolist()), {1.0: (b, c)}, never=0.0)
                found += [chase.first(0.0, 1.0)[0], *chase.pieces(1.0)]
        return found

    def after(self, state, summary):
        if not len(summary):
            return state
        out, at = [], 0
        for level in (state[0], -state[1]) if state else (0.0, 0.0):
            pieces, to = _parts(summary, at + 1)
            out.append(summary[at] if level == 0 or math.isnan(level) else _through(pieces, level, 1.0)[0])
            at = to
        return (out[0], -out[1])

    def packed(self, state):
        return [] if state is None else [float(x) for x in state]

    def sql(self, at):
        c, b, a = self.inputs
        long = f"CASE WHEN p.{at}l <> 0 AND n.{c} > p.{at}l AND p.{at}l > n.{b} THEN p.{at}l ELSE n.{b} END"
        short = f"CASE WHEN p.{at}s <> 0 AND n.{c} < p.{at}s AND p.{at}s < n.{a} THEN p.{at}s ELSE n.{a} END"
        return {f"{at}l": (f"n.{b}", long), f"{at}s": (f"n.{a}", short)}, [f"e.{at}l", f"e.{at}s"]


class Flipping(Recurrence):
    """A trend line that follows below an uptrend and above a downtrend. inputs: close, band below, band above. The first row has direction 1 and trend 0.

    Without a close, and without a trend before, the direction is down. Without the band on its side there is no trend.
    """

    outputs = 2

    @staticmethod
    def _step(close: list[float], below: list[float], above: list[float]):
        def step(t, trend, was):
            to = 1.0 if close[t] > trend else -1.0
            if to != was:
                return (below[t] if to > 0 else above[t]), to
            return (trend if trend > below[t] else below[t]) if to > 0 else (trend if trend < above[t] else above[t]), to

        return step

    def run(self, state, close, below, above):
        outs = np.full((2, len(close)), np.nan)
        step = self._step(close.tolist(), below.tolist(), above.tolist())
        for i in range(len(close)):
            state = (0.0, 1.0) if state is None else step(i, *state)
            outs[:, i] = state
        return tuple(outs), state

    def summary(self, close, below, above):
        """Where a series ends that begins here; for up and down: where one without a trend ends, and the pieces of what becomes of others."""
        if not len(close):
            return []
        chase = Chase(self._step(close.tolist(), below.tolist(), above.tolist()), {1.0: (below, close), -1.0: (np.where(np.isnan(close), -np.inf, close), np.nextafter(above, np.inf))})
        found = [*chase.end(0, 0.0, 1.0)]
        for side in (1.0, -1.0):
            found += [*chase.first(math.nan, side), *chase.pieces(side)]
        return found

    def after(self, state, summary):
        if not len(summary):
            return state
        if state is None:
            return tuple(summary[:2])
        up, to = _parts(summary, 4)
        down, _ = _parts(summary, to + 2)
        trend, side = state
        if math.isnan(trend):
            return tuple(summary[2:4] if side > 0 else summary[to : to + 2])
        return _through(up if side > 0 else down, trend, side)

    def sql(self, at):
        c, b, a = self.inputs
        to = f"(CASE WHEN n.{c} > p.{at}t THEN 1e0 ELSE -1e0 END)"
        trend = f"CASE WHEN {to} <> p.{at}d AND {to} > 0 THEN n.{b} WHEN {to} <> p.{at}d THEN n.{a} WHEN {to} > 0 AND p.{at}t > n.{b} THEN p.{at}t WHEN {to} > 0 THEN n.{b} WHEN p.{at}t < n.{a} THEN p.{at}t ELSE n.{a} END"
        return {f"{at}t": ("0e0", trend), f"{at}d": ("1e0", to)}, [f"e.{at}t", f"e.{at}d"]


class OrderZone(Recurrence):
    """Whether a zone set by an impulse still holds. inputs: whether one is set here (0 or 1), its far edge, whether price is tested from below (+1) or above (-1) by the value in the last input."""

    def run(self, state, sets, edge, value):
        side = self.params[0]
        valid, at = state or (0.0, 0.0)
        out = np.empty(len(sets))
        for i, (s, e, v) in enumerate(zip(sets.tolist(), edge.tolist(), value.tolist(), strict=True)):
            if valid and side * v < side * at:
                valid = 0.0
            if s == 1:
                valid, at = 1.0, e
            out[i] = valid
        return (out,), (valid, at)

    def summary(self, sets, edge, value):
        """Whether a zone is set, and if so how the last one fares; else the value nearest to breaking one."""
        at = np.flatnonzero(sets == 1)
        if len(at):
            return [1.0, *self.run(None, *(x[at[-1] :] for x in (sets, edge, value)))[1], 0.0]
        tests = self.params[0] * value[~np.isnan(value)]
        return [0.0, 0.0, 0.0, float(tests.min(initial=np.inf))]

    def after(self, state, summary):
        if summary[0]:
            return (summary[1], summary[2])
        valid, at = state or (0.0, 0.0)
        return (0.0 if valid and summary[3] < self.params[0] * at else valid, at)

    def sql(self, at):
        s, e, v = self.inputs
        side = repr(self.params[0])
        held = f"CASE WHEN n.{s} = 1 THEN 1e0 WHEN p.{at}v = 1 AND {side} * n.{v} < {side} * p.{at}e THEN 0e0 ELSE p.{at}v END"
        return {f"{at}v": (f"CASE WHEN n.{s} = 1 THEN 1e0 ELSE 0e0 END", held), f"{at}e": (f"CASE WHEN n.{s} = 1 THEN n.{e} ELSE 0e0 END", f"CASE WHEN n.{s} = 1 THEN n.{e} ELSE p.{at}e END")}, [f"e.{at}v"]


def _runs(batch: pa.RecordBatch) -> tuple[list[int], list[tuple]]:
    """Where runs of one series begin, the end included, and the series of each run."""
    codes = np.zeros(batch.num_rows, dtype=bool)
    columns = [batch.column(batch.schema.get_field_index(k)) for k in KEYS]
    for column in columns:
        code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        codes[1:] |= code[1:] != code[:-1]
    starts = [0, *np.flatnonzero(codes).tolist()]
    return [*starts, batch.num_rows], [tuple(c[i].as_py() for c in columns) for i in starts]


def scan_series(df: DataFrame, scans: dict[tuple[str, ...], Recurrence]) -> DataFrame:
    """``df`` with the outputs of each recurrence, named by the keys of ``scans``."""
    inputs = {x for scan in scans.values() for x in scan.inputs}
    df = df.withColumns({x: df[x].cast("double") for x in sorted(inputs) if df.schema[x].dataType.simpleString() != "double"})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for names in scans for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = {x: batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(float) for s in scans.values() for x in s.inputs}
            found = {n: np.empty(batch.num_rows) for names in scans for n in names}
            bounds, series = _runs(batch)
            for start, end, own in zip(bounds, bounds[1:], series, strict=False):
                if own != current:
                    current, states = own, {}
                for names, scan in scans.items():
                    outs, states[names] = scan.run(states.get(names), *(values[x][start:end] for x in scan.inputs))
                    for n, out in zip(names, outs, strict=True):
                        found[n][start:end] = out
            arrays = [pa.array(found[n], pa.float64(), from_pandas=True) for n in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *found])

    return df.repartition(*KEYS).sortWithinPartitions(*KEYS, ORDER).mapInArrow(run, schema)
