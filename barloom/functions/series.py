"""Building blocks of indicators: each returns the name or text of a column."""

from __future__ import annotations

from barloom.functions import sql as s
from barloom.plans.frame import Columns


def sma(b: Columns, x: str, n: int) -> str:
    """The mean of n rows, 0 before there are n."""
    return b.let(s.fill(b.over("avg({})", x, n)))


def stddev(b: Columns, x: str, n: int) -> str:
    """The sample deviation of n rows, 0 before there are n."""
    return b.let(s.fill(b.over("stddev_samp({})", x, n, 2)))


def rolling_sum(b: Columns, x: str, n: int) -> str:
    return b.let(s.fill(b.over("sum({})", x, n)))


def highest(b: Columns, x: str, n: int) -> str:
    return b.over("max({})", x, n)


def lowest(b: Columns, x: str, n: int) -> str:
    return b.over("min({})", x, n)


def cumulative(b: Columns, x: str) -> str:
    return b.so_far("sum({})", s.fill(x))


def ema(b: Columns, x: str, n: int) -> str:
    if n < 1:
        raise ValueError("a length is at least 1")
    return b.smoothed(x, 2 / (n + 1))


def rma(b: Columns, x: str, n: int) -> str:
    """Wilder's average; gaps repeat the last value, and what has none before is 0."""
    if n < 1:
        raise ValueError("a length is at least 1")
    return b.smoothed(s.fill(b.forward(x)), 1 / n)


def wilder(b: Columns, x: str, n: int) -> str:
    if n < 1:
        raise ValueError("a length is at least 1")
    return b.let(s.fill(b.smoothed(x, 1 / n)))


def change(b: Columns, x: str) -> str:
    return b.let(f"{b.let(x)} - {b.lag(x)}")


def true_range(b: Columns) -> str:
    before = b.let(f"coalesce({b.lag('close')}, close)")
    return b.let(s.fill(f"greatest(abs(high - low), abs(high - {before}), abs(low - {before}))"))


def atr(b: Columns, n: int) -> str:
    return wilder(b, true_range(b), n)


def money_flow(range_rule: str = s.EPS) -> str:
    return s.div("(close - low) - (high - close)", f"(high - low) + {range_rule}")


def chaikin(b: Columns, n: int) -> str:
    """Rolling money flow over rolling volume, not clipped."""
    return b.let(s.guarded(rolling_sum(b, f"{money_flow()} * volume", n), rolling_sum(b, "volume", n)))


def zscore(b: Columns, x: str, n: int, limit: float = 10.0) -> str:
    x = b.let(s.fill(b.forward(x)))
    return b.let(s.clip(s.fill(s.guarded(f"{x} - {sma(b, x, n)}", stddev(b, x, n))), -limit, limit))


def plain_zscore(b: Columns, x: str, n: int) -> str:
    x = b.let(x)
    return b.let(s.guarded(f"{x} - {sma(b, x, n)}", stddev(b, x, n)))


def pivots(b: Columns, x: str, left: int, right: int) -> str:
    """1 at a swing high, -1 at a swing low, else 0. Looks ``right`` rows ahead; rows without full sides are 0."""
    if left < 1 or right < 1:
        raise ValueError("a pivot needs rows on both sides")
    x = b.let(x)
    before, after = f"OVER ({s.SERIES} ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING)", f"OVER ({s.SERIES} ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING)"
    whole = f"count({x}) {before} = {left} AND count({x}) {after} = {right}"
    high = f"{whole} AND {x} > max({x}) {before} AND {x} >= max({x}) {after}"
    low = f"{whole} AND {x} < min({x}) {before} AND {x} <= min({x}) {after}"
    return b.let(s.case((high, "1"), (low, "-1"), otherwise="0"))


def rsi(b: Columns, x: str, n: int) -> str:
    d = change(b, x)
    gain = rma(b, s.case((f"{d} > 0", d), otherwise="0e0"), n)
    loss = rma(b, s.case((f"{d} < 0", f"-{d}"), otherwise="0e0"), n)
    return b.let(f"100e0 - 100e0 / (1e0 + {s.guarded(gain, loss)})")


def directional(b: Columns, di_len: int, adx_len: int) -> tuple[str, str, str]:
    """Plus and minus directional indicators and their smoothed spread."""
    up, down = b.let(f"high - {b.lag('high')}"), b.let(f"{b.lag('low')} - low")
    plus = s.case((f"{up} > {down} AND {up} > 0", up), otherwise="0e0")
    minus = s.case((f"{down} > {up} AND {down} > 0", down), otherwise="0e0")
    width = atr(b, di_len)
    plus_di = b.let(f"100e0 * {s.guarded(rma(b, plus, di_len), width)}")
    minus_di = b.let(f"100e0 * {s.guarded(rma(b, minus, di_len), width)}")
    spread = f"100e0 * {s.guarded(f'abs({plus_di} - {minus_di})', f'{plus_di} + {minus_di}')}"
    return plus_di, minus_di, rma(b, spread, adx_len)


def on_balance(b: Columns) -> str:
    d = change(b, "close")
    return cumulative(b, f"coalesce(sign({d}), 0e0) * volume")


def covariance(b: Columns, x: str, y: str, n: int) -> str:
    """Sample covariance of n rows in which both have a value; null before."""
    x, y = b.let(x), b.let(y)
    both = b.let(s.case((f"{x} IS NOT NULL AND {y} IS NOT NULL", "1")))
    return b.let(f"CASE WHEN count({both}) {s.frame(n - 1)} = {n} THEN covar_samp({x}, {y}) {s.frame(n - 1)} END")


def correlation(b: Columns, x: str, y: str, n: int) -> str:
    """Null before n rows, and where one side doesn't move."""
    x, y = b.let(x), b.let(y)
    return b.let(s.div(covariance(b, x, y, n), f"{b.over('stddev_samp({})', x, n, 2)} * {b.over('stddev_samp({})', y, n, 2)}"))
