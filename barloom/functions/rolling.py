"""Rolling statistics that no aggregate expresses, as recurrences whose state is the rows of the open window."""

from __future__ import annotations

import numpy as np

from barloom.functions.recurrences import Recurrence

ROWS = 2048


class Windowed(Recurrence):
    """``of`` gets a matrix for each input, a window in each row, and returns a value for each. Windows with nulls, and rows without a full window, get ``empty``."""

    empty = np.nan
    #: 1 if the row itself is not in its window.
    shift = 0

    @property
    def width(self) -> int:
        return int(self.params[0])

    @property
    def reach(self) -> int:
        return self.width - 1 + self.shift

    def of(self, *windows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def along(self, whole: np.ndarray, *xs: np.ndarray) -> np.ndarray:
        """The values of the windows of a stretch of rows that ``whole`` picks; kinds whose windows share work do it here."""
        return self.of(*(np.lib.stride_tricks.sliding_window_view(x, self.width)[whole] for x in xs))

    def run(self, state, *xs):
        w, n = self.width, len(xs[0])
        before = state if state is not None else tuple(np.empty(0) for _ in xs)
        joined = [np.concatenate(pair) for pair in zip(before, xs, strict=True)]
        out = np.full(n, self.empty)
        first = max(0, w - 1 + self.shift - len(before[0]))  # first row with a full window
        for at in range(first, n, ROWS):
            to = min(at + ROWS, n)
            start = at + len(before[0]) - self.shift - w + 1
            parts = [x[start : start + to - at + w - 1] for x in joined]
            holes = np.any([np.isnan(p) for p in parts], axis=0)
            passed = np.concatenate([[0], np.cumsum(holes)])
            whole = passed[w:] == passed[:-w]
            if whole.any():
                out[at:to][whole] = self.along(whole, *parts)
        return (out,), tuple(x[max(0, len(x) - (w - 1 + self.shift)) :] for x in joined)


def _slope(n, sx, sy, sxx, sxy) -> np.ndarray:
    """The slope of a line through points, from 0 to 1; none for less than two."""
    return np.clip(np.divide(n * sxy - sx * sy, n * sxx - sx * sx, out=np.full(len(n), np.nan), where=n >= 2), 0.0, 1.0)


class HurstExponent(Windowed):
    """Slope of rescaled range over length, in logarithms, of the differences in each window. params: window, shortest and longest part; parts double in length."""

    def of(self, x):
        d = np.diff(x, axis=1)
        lengths, _, longest = int(self.params[1]), 0, int(self.params[2])
        sums = np.zeros((5, len(d)))  # n, x, y, xx, xy
        while lengths <= min(longest, d.shape[1]):
            parts = d[:, d.shape[1] % lengths :].reshape(len(d), -1, lengths)
            walk = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
            wide = parts.std(axis=2)
            moves = wide > 1e-12
            ratio = np.divide(walk.max(axis=2) - walk.min(axis=2), wide, out=np.zeros_like(wide), where=moves)
            count = moves.sum(axis=1)
            mean = np.divide(ratio.sum(axis=1), count, out=np.zeros(len(d)), where=count > 0)
            used = mean > 0
            y, lx = np.log(np.where(used, mean, 1.0)), np.log(lengths)
            sums += np.where(used, 1.0, 0.0) * np.stack([np.ones(len(d)), np.full(len(d), lx), y, np.full(len(d), lx * lx), lx * y])
            lengths *= 2
        return _slope(*sums)


    def along(self, whole, x):
        """A part's rescaled range is the same in every window that has the part: each is found once, and windows add up those that end where theirs do."""
        d = np.diff(np.nan_to_num(x))
        ends = np.flatnonzero(whole) + self.width - 2  # the last difference of each window
        length, longest, sums = int(self.params[1]), int(self.params[2]), np.zeros((5, len(ends)))
        while length <= min(longest, self.width - 1):
            parts = np.lib.stride_tricks.sliding_window_view(d, length)
            walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
            wide = parts.std(axis=1)
            moves = wide > 1e-12
            ratio = np.divide(walk.max(axis=1) - walk.min(axis=1), wide, out=np.zeros_like(wide), where=moves)
            own = [ends - length + 1 - k * length for k in range((self.width - 1) // length)]
            total, count = sum(ratio[i] for i in own), sum(moves[i].astype(int) for i in own)
            mean = np.divide(total, count, out=np.zeros(len(ends)), where=count > 0)
            used = mean > 0
            y, lx = np.log(np.where(used, mean, 1.0)), np.log(length)
            sums += np.where(used, 1.0, 0.0) * np.stack([np.ones(len(ends)), np.full(len(ends), lx), y, np.full(len(ends), lx * lx), lx * y])
            length *= 2
        return _slope(*sums)


def _longest(power: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The first of the strongest periods: what differs by rounding is equal, as after a single move all are."""
    return (power >= top[:, None] * (1 - 1e-9)).argmax(axis=1)


class DominantPeriod(Windowed):
    """The period with most power in each window. params: window, shortest and longest period; the longest of equals wins."""

    def of(self, x):
        w = x.shape[1]
        periods = w / np.arange(1, w // 2 + 1)
        allowed = np.flatnonzero((periods >= self.params[1]) & (periods <= self.params[2]))
        if not len(allowed):
            return np.full(len(x), np.nan)
        power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1))[:, 1 : w // 2 + 1] ** 2
        top = power[:, allowed].max(axis=1)
        best = _longest(power[:, allowed], top)
        scale = np.maximum(1.0, np.abs(x).max(axis=1)) * w
        return np.where(top > (1e-12 * scale) ** 2, periods[allowed][best], np.nan)


    def along(self, whole, x):
        """Of each period, one turning sum along the rows; a window's transform is the difference of two of its values. Sums begin anew with each stretch of rows."""
        w = self.width
        turns = np.arange(1, w // 2 + 1)
        turns = turns[(w / turns >= self.params[1]) & (w / turns <= self.params[2])]
        start = np.flatnonzero(whole)
        if not len(turns):
            return np.full(len(start), np.nan)
        level = x[start[0]]  # periods don't see the level; without it, sums of flat stretches stay small
        moved = np.where(np.isnan(x), 0.0, x - level)
        phase = np.exp(-2j * np.pi * (np.outer(np.arange(len(x)), turns) % w) / w)
        sums = np.concatenate([np.zeros((1, len(turns))), np.cumsum(moved[:, None] * phase, axis=0)])
        power = np.abs(sums[start + w] - sums[start]) ** 2
        top = power.max(axis=1)
        best = _longest(power, top)
        largest = np.lib.stride_tricks.sliding_window_view(np.abs(np.nan_to_num(x)), w)[whole].max(axis=1)
        return np.where(top > (1e-12 * np.maximum(1.0, largest) * w) ** 2, (w / turns)[best], np.nan)


def value_area(profile: np.ndarray, share: float) -> tuple[int, int, int]:
    """Where most volume is, and the first and last bin of the area around it with ``share`` of all volume; the lower neighbour wins ties."""
    low = high = top = int(profile.argmax())
    held, target = profile[top], profile.sum() * share
    while held < target and (low > 0 or high < len(profile) - 1):
        above = profile[high + 1] if high < len(profile) - 1 else -1.0
        below = profile[low - 1] if low > 0 else -1.0
        if above > below:
            high, held = high + 1, held + above
        else:
            low, held = low - 1, held + below
    return top, low, high


class ProfileShape(Windowed):
    """How far the busiest price is from the middle of the value area, for the rows before this one. inputs: high, low, volume; params: window, bins, share."""

    empty, shift = 0.0, 1

    def of(self, high, low, volume):
        bins, share = int(self.params[1]), self.params[2]
        bottom, size = low.min(axis=1), (high.max(axis=1) - low.min(axis=1)) / bins
        out = np.zeros(len(high))
        for i in np.flatnonzero((size * bins >= 1e-9) & (volume.sum(axis=1) >= 1e-9)):
            first = np.maximum(0, ((low[i] - bottom[i]) / size[i]).astype(int))
            last = np.minimum(bins - 1, ((high[i] - bottom[i]) / size[i]).astype(int))
            each = np.where(last >= first, volume[i] / np.maximum(1, last - first + 1), 0.0)  # a bar at the very top may touch no bin
            last = np.maximum(last, first)
            edges = np.bincount(first, each, bins + 2) - np.bincount(last + 1, each, bins + 2)
            top, lower, upper = value_area(np.cumsum(edges)[:bins], share)
            out[i] = (top - (lower + upper) / 2) / (bins / 2 + 1e-9)
        return out
