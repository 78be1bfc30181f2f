"""The indicator library: each entry makes raw values from bars and turns them into bounded features."""

from barloom.operators.indicators import bands, flow, momentum, profile, relations, structure, trend  # noqa: F401
from barloom.operators.indicators.registry import INDICATORS, Indicator

__all__ = ["INDICATORS", "Indicator"]
