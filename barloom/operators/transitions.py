"""Transition matrices between states, as array columns and with Spark expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(row: Column) -> Column:
    top = F.array_max(row)
    powers = F.transform(row, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def _matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def identity(states: int) -> Column:
    return _matrix([[float(i == j) for j in range(states)] for i in range(states)])


def persistent_logits(states: int, stay: float = 2.0) -> list[list[float]]:
    return [[stay * (i == j) for j in range(states)] for i in range(states)]


def static_transition(states: int, logits: Sequence[Sequence[float]] | None = None) -> Column:
    """The same row-stochastic matrix for each row of a table."""
    return F.transform(_matrix(logits or persistent_logits(states)), softmax)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """weights: a row for each output."""
    return F.zip_with(F.transform(_matrix(weights), lambda w: dot(x, w)), F.array(*[F.lit(float(b)) for b in bias]), lambda y, b: y + b)


def gelu(x: Column) -> Column:
    """x times the normal distribution's integral, whose error function is by a series of six terms that is right to 3e-7."""
    z = F.abs(x) / F.lit(2.0**0.5)
    poly = F.lit(1.0)
    for k, a in enumerate((0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638), 1):  # fixed values of the published approximation
        poly = poly + a * F.pow(z, F.lit(float(k)))
    erf = (1.0 - F.pow(poly, F.lit(-16.0))) * F.signum(x)
    return x * (1.0 + erf) / 2.0


def dynamic_transition(x: Column, weights: dict[str, Sequence], states: int) -> Column:
    """A matrix for each row from its vector x: two layers with a GELU between, then a softmax of each matrix row.

    weights: w1, b1, w2, b2. Use for small layers; for wide ones ``encoders.score`` works on Arrow batches.
    """
    hidden = F.transform(linear(x, weights["w1"], weights["b1"]), gelu)
    logits = linear(hidden, weights["w2"], weights["b2"])
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda i: softmax(F.slice(logits, i * states + 1, states)))


def frozen(matrix: Column, open_: Column, states: int) -> Column:
    """The identity where the market is closed or it isn't known: states can't change then."""
    return F.when(F.coalesce(open_, F.lit(False)), matrix).otherwise(identity(states))


def order_flow() -> Column:
    """Signed volume by where the close lies in the bar; a bar without range counts as one of 1e-12."""
    return ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / F.greatest(F.abs(F.col("high") - F.col("low")), F.lit(1e-12)) * F.col("volume")
