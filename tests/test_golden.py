"""Raw indicators over bars with gaps, nulls in every column and flat stretches, against plain loops written from their definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.plans.features import feature_table, single
from plain import rolling, sd, smooth
from test_blocks import ROWS, gapped
from test_recurrences import stops


def ffill(xs):
    out, last = [], None
    for x in xs:
        last = x if x is not None else last
        out.append(last)
    return out


def fill(xs, value=0.0):
    return [value if x is None else x for x in xs]


def each(f, *columns):
    """f of the values of a row, nothing where one is missing."""
    return [None if None in row else f(*row) for row in zip(*columns, strict=True)]


def lag(xs):
    return [None, *xs[:-1]]


def true_range(bar):
    before = [c if p is None else p for p, c in zip(lag(bar["close"]), bar["close"], strict=True)]
    out = []
    for h, low, b in zip(bar["high"], bar["low"], before, strict=True):
        spans = [abs(x - y) for x, y in ((h, low), (h, b), (low, b)) if x is not None and y is not None]
        out.append(max(spans, default=0.0))
    return out


def wilder(xs, n):
    return fill(smooth(xs, 1 / n))


def rma(xs, n):
    return smooth(fill(ffill(xs)), 1 / n)


def sma(xs, n):
    return fill(rolling(xs, n, lambda w: sum(w) / n))


def total(xs, n):
    return fill(rolling(xs, n, sum))


def moves(bar):
    return each(lambda a, b: a - b, bar["close"], lag(bar["close"]))


def atr(bar, n):
    return wilder(true_range(bar), n)


def rsi(bar, n):
    gain = rma([d if d is not None and d > 0 else 0.0 for d in moves(bar)], n)
    loss = rma([-d if d is not None and d < 0 else 0.0 for d in moves(bar)], n)
    return {"rsi": [100 - 100 / (1 + g / (x + 1e-9)) for g, x in zip(gain, loss, strict=True)]}


def on_balance(bar):
    at, out = 0.0, []
    for d, v in zip(moves(bar), bar["volume"], strict=True):
        at += (0.0 if d is None else float(np.sign(d))) * (v or 0.0)
        out.append(at)
    return {"obv": out}


def money(bar):
    return each(lambda h, low, c, v: ((c - low) - (h - c)) / (h - low + 1e-9) * v, bar["high"], bar["low"], bar["close"], bar["volume"])


def chaikin(bar, n):
    return {"value": [m / (v + 1e-9) for m, v in zip(total(money(bar), n), total(bar["volume"], n), strict=True)]}


def bollinger(bar, n, k):
    middle, wide = sma(bar["close"], n), fill(rolling(bar["close"], n, sd))
    return {"middle": middle, "upper": [m + k * w for m, w in zip(middle, wide, strict=True)], "lower": [m - k * w for m, w in zip(middle, wide, strict=True)]}


def donchian(bar, n):
    high, low = rolling(bar["high"], n, max), rolling(bar["low"], n, min)
    return {"upper": high, "lower": low, "middle": each(lambda a, b: (a + b) / 2, high, low)}


def chandelier(bar, n, k):
    reach = atr(bar, n)
    below = each(lambda h, r: h - k * r, rolling(bar["high"], n, max), reach)
    above = each(lambda low, r: low + k * r, rolling(bar["low"], n, min), reach)
    found = stops(list(zip(bar["close"], below, above, strict=True)))
    return {"longstop": [x for x, _ in found], "shortstop": [x for _, x in found]}


def supertrend(bar, n, k):
    reach, trend, way, trends, ways = atr(bar, n), 0.0, 1.0, [], []
    for i, (h, low, c) in enumerate(zip(bar["high"], bar["low"], bar["close"], strict=True)):
        if i:
            middle = None if h is None or low is None else (h + low) / 2
            below, above = (None, None) if middle is None else (middle - k * reach[i], middle + k * reach[i])
            to = 1.0 if c is not None and trend is not None and c > trend else -1.0
            band, better = (below, max) if to > 0 else (above, min)
            trend = band if to != way or band is None or trend is None else better(band, trend)
            way = to
        trends.append(trend)
        ways.append(way)
    return {"trend": trends, "direction": ways}


def oscillator(bar, fast, slow):
    middle = each(lambda h, low: (h + low) / 2, bar["high"], bar["low"])
    return {"ao": [a - b for a, b in zip(sma(middle, fast), sma(middle, slow), strict=True)]}


CASES = {
    "ATR": ({"Len": 7}, lambda b: {"atr": atr(b, 7)}), "RSI": ({"period": 5}, lambda b: rsi(b, 5)), "OBV": ({}, on_balance), "CMF": ({"period": 4}, lambda b: chaikin(b, 4)), "AO": ({"fast": 2, "slow": 5}, lambda b: oscillator(b, 2, 5)),
    "Bollinger_Bands": ({"period": 4, "std": 2.0}, lambda b: bollinger(b, 4, 2.0)), "Donchian": ({"period": 4}, lambda b: donchian(b, 4)), "Chandelier_Exit": ({"atr_len": 4, "multiplier": 1.5}, lambda b: chandelier(b, 4, 1.5)),
    "SuperTrend": ({"atr_len": 5, "multiplier": 1.0}, lambda b: supertrend(b, 5, 1.0)),
}


def columns(rows):
    return {c: [r[i] for r in rows] for i, c in enumerate(("open", "high", "low", "close", "volume"), 3)}


@pytest.mark.parametrize("name", CASES)
def test_raw_values_with_nulls(spark, name):
    params, want = CASES[name]
    rows = gapped(13, ("a", "b"), 160, 0.06)
    got = feature_table(spark.createDataFrame(rows, ROWS), single(name, **params), features=False, keep=()).collect()
    for symbol in "ab":
        own = sorted((r for r in got if r["symbol"] == symbol), key=lambda r: r["datetime"])
        bar = columns(sorted((r for r in rows if r[0] == symbol), key=lambda r: r[2]))
        for column, values in want(bar).items():
            found = [r[f"{name.lower()}__{column}"] for r in own]
            np.testing.assert_allclose(np.array(found, dtype=float), np.array(values, dtype=float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=column)


def test_factors_by_singular_values(spark):
    """Oscillator, money flow and strength by loops, scaled, turned to their axes; each axis points where its largest loading does."""
    rows = gapped(17, ("a",), 200, 0.0)
    bar = columns(sorted(rows, key=lambda r: r[2]))
    middle = each(lambda h, low: (h + low) / 2, bar["high"], bar["low"])
    swing = each(lambda a, b: a - b, rolling(middle, 5, lambda w: sum(w) / 5), rolling(middle, 34, lambda w: sum(w) / 34))
    flow = each(lambda h, low, c, v: ((c - low) - (h - c)) / (1.0 if h == low else h - low) * v, bar["high"], bar["low"], bar["close"], bar["volume"])
    flows = each(lambda a, b: a / b, rolling(flow, 20, sum), rolling(bar["volume"], 20, sum))
    d = fill(moves(bar))
    gain, loss = smooth([max(x, 0.0) for x in d], 2 / 15), smooth([max(-x, 0.0) for x in d], 2 / 15)
    strength = [100.0 if not x else 100 - 100 / (1 + g / x) for g, x in zip(gain, loss, strict=True)]
    table = [r for r in zip(swing, flows, strength, strict=True) if None not in r]
    x = np.array(table)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    axes = np.linalg.svd(x, full_matrices=False)[2]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    want = np.full((len(rows), 2), math.nan)
    want[len(rows) - len(table) :] = (x @ axes.T)[:, :2]
    got = feature_table(spark.createDataFrame(rows, ROWS), single("PCA"), features=False, keep=()).orderBy("datetime").collect()
    np.testing.assert_allclose(np.array([[r["pca__pc1"], r["pca__pc2"]] for r in got], dtype=float), want, rtol=1e-7, atol=1e-9, equal_nan=True)
