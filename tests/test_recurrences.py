from __future__ import annotations

import math
import random

import numpy as np
import pytest

import plain
from barloom.functions import recurrences as rec
from barloom.functions.rolling import DominantPeriod, HurstExponent, ProfileShape
from barloom.plans.frame import Columns

NAN = float("nan")


def through(scan, xs, cuts):
    """The outputs of a recurrence whose input comes in pieces."""
    state, outs = None, []
    for a, b in zip([0, *cuts], [*cuts, len(xs[0])], strict=True):
        got, state = scan.run(state, *(np.array(x[a:b], dtype=float) for x in xs))
        outs.append(got)
    return [np.concatenate([o[i] for o in outs]) for i in range(len(outs[0]))]


def none_to_nan(xs):
    return [NAN if x is None else x for x in xs]


SERIES = {
    "plain": [random.Random(3).uniform(-5, 5) for _ in range(60)],
    "leading": [None, None, None, *[float(i % 7) for i in range(40)]],
    "gaps": [None if i % 5 == 2 else float(i * i % 11) for i in range(50)],
    "empty": [None] * 10,
    "constant": [0.1] * 30,
}


@pytest.mark.parametrize("name", SERIES)
@pytest.mark.parametrize("cuts", [[], [1], [7, 8, 30]])
@pytest.mark.parametrize("a", [1.0, 0.5, 2 / 15])
def test_smoothed_follows_the_loop_across_batches(name, cuts, a):
    xs = SERIES[name]
    got = through(rec.Smoothed(("x",), (a,)), [none_to_nan(xs)], [c for c in cuts if c < len(xs)])[0]
    np.testing.assert_allclose(got, none_to_nan(plain.smooth(xs, a)), rtol=1e-12, equal_nan=True)


def test_smoothed_stands_still_where_the_series_does():
    got = through(rec.Smoothed(("x",), (2 / 51,)), [[0.1] * 1000], [137])[0]
    assert (got == 0.1).all()


@pytest.mark.parametrize("name", SERIES)
@pytest.mark.parametrize("counted", [False, True])
def test_weighted_follows_the_definition(name, counted):
    xs = SERIES[name]
    got = through(rec.Weighted(("x",), (2 / 9, float(counted))), [none_to_nan(xs)], [c for c in (4, 20) if c < len(xs)])[0]
    np.testing.assert_allclose(got, none_to_nan(plain.weighted(xs, 8, counted)), rtol=1e-12, equal_nan=True)


def test_kalman_supertrend_and_stops_by_pieces():
    bars = plain.walk(80)
    close = [b[6] for b in bars]
    whole, cut = (through(rec.Kalman(("x",), (0.001, 0.1)), [close], c)[0] for c in ([], [3, 50]))
    np.testing.assert_array_equal(whole, cut)
    level, p = close[0], 1.0
    for z in close[1:]:
        p += 0.001
        k = p / (p + 0.1)
        level, p = level + k * (z - level), (1 - k) * p
    assert math.isclose(whole[-1], level, rel_tol=1e-12)
    below, above = [c - 2 for c in close], [c + 2 for c in close]
    for kind in (rec.Trailing, rec.Flipping):
        a, b = (through(kind(("c", "b", "a"), ()), [close, below, above], c) for c in ([], [1, 40]))
        np.testing.assert_array_equal(a, b)
    long = through(rec.Trailing(("c", "b", "a"), ()), [close, below, above], [])[0]
    for i in range(1, len(close)):
        assert long[i] == (max(below[i], long[i - 1]) if close[i] > long[i - 1] else below[i])


def stops(rows):
    """Stops by their definition: what is null compares with nothing, and a null candidate is the stop."""
    long, short, out = 0.0, 0.0, []
    for c, b, a in rows:
        long = max(b, long) if None not in (b, long, c) and long != 0 and c > long else b
        short = min(a, short) if None not in (a, short, c) and short != 0 and c < short else a
        out.append((long, short))
    return out


def test_stops_with_nulls_by_the_loop():
    rng = random.Random(8)
    for _ in range(300):
        price, rows = 50.0, []
        for _ in range(60):
            price += rng.uniform(-2, 2)
            c, b, a = price, price - rng.uniform(0, 3), price + rng.uniform(0, 3)
            rows.append(tuple(None if rng.random() < 0.1 else x for x in (c, b, a)))
        got = through(rec.Trailing(("c", "b", "a"), ()), [none_to_nan(x) for x in zip(*rows, strict=True)], [13, 40])
        want = stops(rows)
        for i in range(2):
            np.testing.assert_array_equal(got[i], none_to_nan([w[i] for w in want]))


KINDS = [(rec.Smoothed, (0.3,)), (rec.Smoothed, (1.0,)), (rec.Weighted, (0.2, 0.0)), (rec.Weighted, (0.2, 1.0)), *[(rec.Running, (float(k),)) for k in range(4)], (rec.Kalman, (0.01, 0.3)), (rec.Trailing, ()), (rec.Flipping, ()), (rec.OrderZone, (1.0,)), (rec.OrderZone, (-1.0,))]


@pytest.mark.parametrize("kind,params", KINDS)
@pytest.mark.parametrize("gaps", [0.0, 0.15, 1.0])
def test_summaries_of_blocks_lead_to_the_same_states(kind, params, gaps):
    """Blocks of any lengths, summed up apart and combined in order, end where one pass over all rows does."""
    rng = np.random.default_rng(len(params))
    for trial in range(120):
        m = int(rng.integers(0, 100))
        base = np.cumsum(rng.normal(size=m)) + (50 if trial % 3 else 0)
        base = np.round(base) if trial % 4 == 0 else base
        wide = rng.integers(1, 5) * rng.random((2, m))
        xs = {rec.Trailing: [base, base - wide[0], base + wide[1]], rec.Flipping: [base, base - wide[0], base + wide[1]], rec.OrderZone: [(rng.random(m) < 0.1).astype(float), base, base + wide[0] - wide[1]]}.get(kind, [base])
        xs = [np.round(x) if trial % 4 == 0 else x.copy() for x in xs]
        for x in xs[kind is rec.OrderZone :]:
            x[rng.random(m) < gaps] = NAN
        scan, state, want = kind(tuple("abc"[: len(xs)]), params), None, None
        cuts = sorted(rng.integers(0, m + 1, 3).tolist())
        for a, b in zip([0, *cuts], [*cuts, m], strict=True):
            if a == b:
                continue
            part = [x[a:b] for x in xs]
            state = scan.after(scan.unpacked(scan.packed(state)), [float(v) for v in scan.summary(*part)])
            want = scan.run(want, *part)[1]
            np.testing.assert_allclose(scan.packed(state), scan.packed(want), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_what_becomes_of_a_stop_has_few_pieces():
    price = np.cumsum(np.random.default_rng(1).normal(size=20_000)) + 500
    assert len(rec.Trailing(("c", "b", "a"), ()).summary(price, price - 3, price + 3)) < 200
    assert len(rec.Flipping(("c", "b", "a"), ()).summary(price, price - 3, price + 3)) < 200


def test_order_zone():
    sets, edge, low = [0, 1, 0, 0, 0, 1, 0], [0, 5, 0, 0, 0, 4, 0], [9, 6, 6, 4, 9, 3, 4]
    got = through(rec.OrderZone(("s", "e", "v"), (1.0,)), [sets, edge, low], [2])[0]
    assert got.tolist() == [0, 1, 1, 0, 0, 1, 1]


def test_hurst_and_period_of_known_series():
    rng = np.random.default_rng(5)
    steps = rng.normal(size=1500)
    up = through(HurstExponent(("x",), (200, 10, 80)), [np.cumsum(np.cumsum(steps)).tolist()], [700])[0]
    zig = through(HurstExponent(("x",), (200, 10, 80)), [steps.tolist()], [])[0]
    assert np.isnan(up[:199]).all() and np.nanmean(up) > 0.85 and np.nanmean(zig) < 0.35
    wave = [math.sin(2 * math.pi * i / 20) for i in range(300)]
    got = through(DominantPeriod(("x",), (100, 10, 50)), [wave], [64, 99, 100])[0]
    assert np.isnan(got[:99]).all() and set(got[99:]) == {20.0}
    still = through(DominantPeriod(("x",), (100, 10, 50)), [[3.0] * 120], [])[0]
    assert np.isnan(still).all()


def hurst_loop(window, shortest, longest):
    """Rescaled ranges of parts that end where the window does, averaged by length; the slope of their logarithms."""
    d = [b - a for a, b in zip(window, window[1:], strict=False)]
    points, length = [], shortest
    while length <= min(longest, len(d)):
        found = []
        for k in range(len(d) // length):
            part = d[len(d) - (k + 1) * length : len(d) - k * length]
            mean = sum(part) / length
            walk, at = [], 0.0
            for v in part:
                at += v - mean
                walk.append(at)
            wide = math.sqrt(sum((v - mean) ** 2 for v in part) / length)
            if wide > 1e-12:
                found.append((max(walk) - min(walk)) / wide)
        if found and sum(found) > 0:
            points.append((math.log(length), math.log(sum(found) / len(found))))
        length *= 2
    if len(points) < 2:
        return NAN
    mx, my = (sum(p[i] for p in points) / len(points) for i in range(2))
    return min(1.0, max(0.0, sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)))


def period_loop(window, shortest, longest):
    """The period with most power by the plain transform of the window less its mean."""
    w, mean = len(window), sum(window) / len(window)
    found = []
    for k in range(1, w // 2 + 1):
        if shortest <= w / k <= longest:
            re, im = (sum((v - mean) * f(2 * math.pi * k * j / w) for j, v in enumerate(window)) for f in (math.cos, math.sin))
            found.append((re * re + im * im, w / k))
    top = max(power for power, _ in found)
    return max(p for power, p in found if power >= top * (1 - 1e-9)) if top > (1e-12 * max(1.0, *map(abs, window)) * w) ** 2 else NAN


def stretches(seed, n=260):
    """A walk with a gap, a flat stretch and a wave."""
    rng, xs, at = random.Random(seed), [], 20.0
    for i in range(n):
        at += 0.0 if 90 <= i < 150 else rng.uniform(-1, 1)
        xs.append(None if i in (30, 31, 200) else at + (3 * math.sin(i / 2) if i > 150 else 0.0))
    return xs


@pytest.mark.parametrize("cuts", [[], [1, 39, 40, 41, 150]])
def test_hurst_and_period_by_the_loops(cuts):
    xs = stretches(4)
    hurst = through(HurstExponent(("x",), (40, 5, 20)), [none_to_nan(xs)], cuts)[0]
    period = through(DominantPeriod(("x",), (40, 4, 20)), [none_to_nan(xs)], cuts)[0]
    for i in range(len(xs)):
        window = xs[i - 39 : i + 1] if i >= 39 else [None]
        if None in window:
            assert math.isnan(hurst[i]) and math.isnan(period[i])
            continue
        np.testing.assert_allclose(hurst[i], hurst_loop(window, 5, 20), rtol=1e-9, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(period[i], period_loop(window, 4, 20), equal_nan=True)


def test_shared_work_gives_what_single_windows_do():
    """Over 100 000 rows, and in a fraction of the time that windows on their own take."""
    x = np.cumsum(np.random.default_rng(2).normal(size=100_000)) + 1000
    x[50_000:50_400], x[70_000] = x[50_000], NAN
    for kind, params in ((HurstExponent, (200, 10, 80)), (DominantPeriod, (100, 10, 50))):
        scan = kind(("x",), params)
        alone = type("Alone", (kind,), {"along": lambda self, whole, *xs: super(kind, self).along(whole, *xs)})(("x",), params)
        np.testing.assert_allclose(scan.run(None, x)[0][0], alone.run(None, x)[0][0], rtol=1e-9, atol=1e-9, equal_nan=True)


def test_profile_shape_against_the_loop():
    bars = plain.walk(60, seed=9)
    high, low, volume = ([b[i] for b in bars] for i in (4, 5, 7))
    got = through(ProfileShape(("h", "l", "v"), (20, 12, 0.7)), [high, low, volume], [5, 33])[0]
    for i in range(60):
        if i < 20:
            assert got[i] == 0
            continue
        h, lo, v = (x[i - 20 : i] for x in (high, low, volume))
        size, profile = (max(h) - min(lo)) / 12, [0.0] * 12
        for a, b, w in zip(h, lo, v, strict=True):
            first, last = int((b - min(lo)) / size), min(11, int((a - min(lo)) / size))
            for j in range(first, last + 1):
                profile[j] += w / (last - first + 1)
        top, lower, upper = plain.value_area(profile, 0.7)
        assert math.isclose(got[i], (top - (lower + upper) / 2) / (6 + 1e-9), abs_tol=1e-9)


def test_series_are_kept_apart_and_batches_do_not_matter(spark):
    rows = plain.walk(40, 1, "a") + plain.walk(40, 2, "b", 50.0) + plain.flat(5)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, plain.BARS)
    b = Columns()
    y = b.ewm("close", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = {(r["symbol"], r["datetime"]): r["y"] for r in b.add_to(df, {"y": y}, ()).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for symbol in "abf":
        own = sorted(r for r in rows if r[0] == symbol)
        want = plain.weighted([r[6] for r in own], 7)
        np.testing.assert_allclose([got[symbol, r[2]] for r in own], want, rtol=1e-12)


def test_equal_columns_are_made_once():
    b = Columns()
    assert b.ewm("close", 5) == b.ewm("close", 5) and b.let("close + 1e0") == b.let("close + 1e0")
    with pytest.raises(ValueError, match="look ahead"):
        b.lag("close", -1)
    with pytest.raises(ValueError, match="too short"):
        b.over("stddev_samp({})", "close", 1, 2)
