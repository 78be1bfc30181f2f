"""Plain loops that the operators are held against, and small series."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

BARS = "symbol string, timeframe string, datetime timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(n: int, seed: int = 1, symbol: str = "a", start: float = 100.0) -> list[tuple]:
    rng, rows, price = random.Random(seed), [], start
    for i in range(n):
        o = price
        c = round(o + rng.uniform(-2, 2), 3)
        h, low = max(o, c) + round(rng.uniform(0, 1), 3), min(o, c) - round(rng.uniform(0, 1), 3)
        rows.append((symbol, "1h", datetime(2024, 1, 1) + timedelta(hours=i), o, h, low, c, float(rng.randrange(0, 50))))
        price = c
    return rows


def flat(n: int, symbol: str = "f") -> list[tuple]:
    return [(symbol, "1h", datetime(2024, 1, 1) + timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(n)]


def smooth(xs: list, a: float) -> list:
    """Seeded with the first value; the old weight fades over nulls."""
    y, gap, out = None, 0, []
    for x in xs:
        if x is None:
            gap += y is not None
            out.append(None)
            continue
        old = (1 - a) ** (gap + 1)
        y = x if y is None else (old * y + a * x) / (old + a)
        gap = 0
        out.append(y)
    return out


def weighted(xs: list, span: int, counted: bool = False) -> list:
    r, out = 1 - 2 / (span + 1), []
    for t, x in enumerate(xs):
        if x is None:
            out.append(None)
            continue
        seen = [(t - i, v) for i, v in enumerate(xs[: t + 1]) if v is not None]
        if not counted:
            seen = [(len(seen) - 1 - k, v) for k, (_, v) in enumerate(seen)]
        out.append(sum(r**age * v for age, v in seen) / sum(r**age for age, _ in seen))
    return out


def rolling(xs: list, n: int, f) -> list:
    return [f(xs[i - n + 1 : i + 1]) if i >= n - 1 and all(x is not None for x in xs[i - n + 1 : i + 1]) else None for i in range(len(xs))]


def sd(xs: list) -> float:
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))


def rsi(closes: list, n: int) -> list:
    moves = [None] + [b - a for a, b in zip(closes, closes[1:], strict=False)]
    gains, losses = [max(m or 0.0, 0.0) for m in moves], [max(-(m or 0.0), 0.0) for m in moves]
    return [100 - 100 / (1 + g / (x + 1e-9)) for g, x in zip(smooth(gains, 1 / n), smooth(losses, 1 / n), strict=True)]


def supertrend(bars: list[tuple], n: int, m: float) -> list[tuple]:
    tr = [max(h - low, abs(h - pc), abs(low - pc)) for (_, _, _, _, h, low, _, _), pc in zip(bars, [bars[0][6]] + [b[6] for b in bars], strict=False)]
    reach, out = smooth(tr, 1 / n), []
    for i, (_, _, _, _, h, low, c, _) in enumerate(bars):
        below, above = (h + low) / 2 - m * reach[i], (h + low) / 2 + m * reach[i]
        if i == 0:
            out.append((0.0, 1.0))
            continue
        trend, was = out[-1]
        to = 1.0 if c > trend else -1.0
        if to != was:
            trend = below if to > 0 else above
        else:
            trend = max(below, trend) if to > 0 else min(above, trend)
        out.append((trend, to))
    return out


def value_area(profile: list[float], share: float) -> tuple[int, int, int]:
    top = profile.index(max(profile))
    low = high = top
    held = profile[top]
    while held < sum(profile) * share and (low > 0 or high < len(profile) - 1):
        above = profile[high + 1] if high + 1 < len(profile) else -1
        below = profile[low - 1] if low > 0 else -1
        if above > below:
            high, held = high + 1, held + above
        else:
            low, held = low - 1, held + below
    return top, low, high


def day_profile(rows: list[tuple], bins: int = 24) -> tuple[float, float, float]:
    """rows: high, low, volume. Returns poc, vah, val."""
    bottom, top = min(r[1] for r in rows), max(r[0] for r in rows)
    if top - bottom < 1e-9:
        return (bottom + top) / 2, top, bottom
    size, profile = (top - bottom) / bins, [0.0] * bins
    for h, low, v in rows:
        first, last = max(0, int((low - bottom) / size)), min(bins - 1, int((h - bottom) / size))
        for j in range(first, last + 1):
            profile[j] += v / (last - first + 1)
    if sum(profile) < 1e-9:
        return (bottom + top) / 2, top, bottom
    at, low, high = value_area(profile, 0.7)
    price = lambda i: bottom + i * size + size / 2
    return price(at), price(high), price(low)
