"""What every indicator declares, and the features that all make from their raw values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from barloom.functions import sql as s
from barloom.plans.frame import Columns

#: Raw values by name: text or name of a column.
Values = dict[str, str]


class Params(dict):
    """Parameters as attributes; a missing one is an error that names it."""

    def __getattr__(self, name: str):
        if name not in self:
            raise ValueError(f"parameter {name} is missing")
        return self[name]

    def positive(self, *names: str) -> None:
        for name in names:
            if not self.get(name):
                raise ValueError(f"parameter {name} must be given and not be 0")


@dataclass(frozen=True)
class Indicator:
    name: str
    kind: str
    prefix: str
    raw: Callable[[Columns, Params], Values]
    features: Callable[[Columns, Values, Params], Values]
    defaults: dict[str, object]
    tables: Callable | None = None  # adds the columns that need more than windows and recurrences

    def params(self, given: dict[str, object] | None = None) -> Params:
        return Params({k: v for k, v in (self.defaults | (given or {})).items() if v is not None})


INDICATORS: dict[str, Indicator] = {}


def indicator(name: str, kind: str, prefix: str, features: Callable, tables: Callable | None = None, **defaults):
    """Registers a function that makes the raw values. ``defaults`` are usual parameters, for plans that give none."""

    def add(raw):
        INDICATORS[name] = Indicator(name, kind, prefix, raw, features, defaults, tables)
        return raw

    return add


def axis(b: Columns, name: str, x: str, stable: tuple[float, float] | None, sensitive: tuple[float, float] | None = None, empty: float = 0.0) -> Values:
    """One feature in two widths: what has no value becomes ``empty``, then both are clipped; without bounds neither happens."""
    x = b.let(x)
    within = lambda bounds: x if bounds is None else s.clip(s.fill(x, s.num(empty)), *bounds)
    return {f"{name}_stable": within(stable), f"{name}_sensitive": within(sensitive or stable)}


def relative(b: Columns, x: str, span: int) -> str:
    """How far x is from its recent mean, in parts of that mean."""
    x = b.let(x)
    mean = b.ewm(x, span)
    return s.guarded(f"{x} - {mean}", f"abs({mean})", s.FEATURE_EPS)


def from_mean(b: Columns, x: str, span: int) -> str:
    x = b.let(x)
    return f"{x} - {b.ewm(x, span)}"


def rough(b: Columns, x: str, n: int) -> str:
    """The rolling deviation, in logarithms."""
    return s.log1p(b.over("stddev_samp({})", x, n, 2))


def standing(b: Columns, x: str, n: int) -> str:
    """The rolling z-score, null before n rows."""
    x = b.let(x)
    return s.guarded(f"{x} - {b.over('avg({})', x, n)}", b.over("stddev_samp({})", x, n, 2), s.FEATURE_EPS)


MOMENTUM = ((-1.0, 1.0), (-5.0, 5.0))


def around(prefix: str, value: Callable, position: tuple, bias: tuple, volatility: tuple, macro: object, micro: object, vol: object, suffix: str = "") -> Callable:
    """The common shape: a scale-free value, its distance from a slow mean, from a fast one, and its roughness.

    macro, micro, vol: a number, or the parameter that stands in where adapt_*_p isn't given.
    """

    def features(b: Columns, h: Values, p: Params) -> Values:
        x = b.let(value(h, p))
        of = lambda key, default: p.get(key, p[default] if isinstance(default, str) else default)
        return (
            axis(b, f"{prefix}_position", x, *position)
            | axis(b, f"{prefix}_bias", from_mean(b, x, of("adapt_macro_p", macro)), *bias)
            | axis(b, f"{prefix}_momentum", relative(b, x, of("adapt_micro_p", micro)), *MOMENTUM)
            | axis(b, f"{prefix}_volatility", rough(b, x, of("adapt_vol_p", vol)), *volatility)
        )

    return features


def channel(prefix: str, low: str, high: str, middle: Callable, period: object, position: tuple, volatility: tuple, bias: tuple, per: Callable | None = None) -> Callable:
    """For an upper and a lower line: place of the close between them, width, distance from the middle, change of the place. per: what the width is divided by (else the middle)."""

    def features(b: Columns, h: Values, p: Params) -> Values:
        micro = p.get("adapt_micro_p", p[period] if isinstance(period, str) else period)
        place = b.let(s.guarded(f"close - {h[low]}", f"{h[high]} - {h[low]}", s.FEATURE_EPS))
        width = b.let(s.guarded(f"{h[high]} - {h[low]}", per(h) if per else middle(h), s.FEATURE_EPS))
        return (
            axis(b, f"{prefix}_position", place, *position, empty=0.5)
            | axis(b, f"{prefix}_volatility", s.log1p(width), *volatility)
            | axis(b, f"{prefix}_bias", f"{s.guarded('close', middle(h), s.FEATURE_EPS)} - 1e0", *bias)
            | axis(b, f"{prefix}_momentum", relative(b, place, micro), *MOMENTUM)
        )

    return features


def events(prefix: str, value: Callable, momentum: tuple, bias: tuple, position: tuple, volatility: tuple, macro: object = 55, micro: object = 13, vol: object = 34, rescaled: bool = True) -> Callable:
    """For rare events: the event itself, its short and its long memory, and how unsteady it is. rescaled: the memories are of the value, not of the event behind it."""

    def features(b: Columns, h: Values, p: Params) -> Values:
        of = lambda key, default: p.get(key, p[default] if isinstance(default, str) else default)
        shown, event = value(h)
        x = b.let(shown if rescaled else event)
        return (
            axis(b, f"{prefix}_momentum", shown, *momentum)
            | axis(b, f"{prefix}_bias", b.ewm(x, of("adapt_micro_p", micro)), *bias)
            | axis(b, f"{prefix}_position", b.ewm(x, of("adapt_macro_p", macro)), *position)
            | axis(b, f"{prefix}_volatility", rough(b, x, of("adapt_vol_p", vol)), *volatility)
        )

    return features
