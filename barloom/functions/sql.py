"""Small builders of SQL text that Spark SQL and DuckDB read alike.

Series are kept apart by (symbol, timeframe) and ordered by datetime. A null stands for "no value" throughout: no
builder makes a NaN, and every division yields null, not an error or an infinity, where the divisor is zero.
"""

from __future__ import annotations

SERIES = "PARTITION BY symbol, timeframe ORDER BY datetime"
#: Guards of the divisions in raw indicators and in their normalised features.
EPS, FEATURE_EPS = "1e-9", "1e-6"


def num(x: float) -> str:
    """A literal that both engines read as a double."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0e0))"


def guarded(a: str, b: str, eps: str = EPS) -> str:
    """a / (b + eps)."""
    return div(a, f"({b}) + {eps}")


def fill(x: str, value: str = "0e0") -> str:
    return f"coalesce({x}, {value})"


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {num(low)}), {num(high)})"


def safe_sqrt(x: str) -> str:
    return fill(f"sqrt(abs({x}))")


def bounded_pow(base: str, exponent: float) -> str:
    """A root is taken of the absolute value; null is 0; the result stays within 1e10."""
    inner = f"abs({base})" if exponent < 1 else base
    return clip(fill(f"power({inner}, {num(exponent)})"), -1e10, 1e10)


def largest(*xs: str) -> str:
    if not xs:
        raise ValueError("largest needs a value")
    return xs[0] if len(xs) == 1 else f"greatest({', '.join(xs)})"


def smallest(*xs: str) -> str:
    if not xs:
        raise ValueError("smallest needs a value")
    return xs[0] if len(xs) == 1 else f"least({', '.join(xs)})"


def log1p(x: str) -> str:
    return f"CASE WHEN ({x}) > -1e0 THEN ln(1e0 + ({x})) END"


def frame(before: int | None, after: int = 0, partition: str = SERIES) -> str:
    """The window of rows from ``before`` rows back (None: from the start) to ``after`` rows ahead (negative: back)."""
    side = lambda k: "CURRENT ROW" if k == 0 else f"{k} FOLLOWING" if k > 0 else f"{-k} PRECEDING"
    return f"OVER ({partition} ROWS BETWEEN {'UNBOUNDED PRECEDING' if before is None else side(-before)} AND {side(after)})"


def full(agg: str, x: str, n: int) -> str:
    """``agg`` over the last n rows, null until all n have a value."""
    return f"CASE WHEN count({x}) {frame(n - 1)} = {n} THEN {agg.format(x)} {frame(n - 1)} END"


def case(*pairs: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"
