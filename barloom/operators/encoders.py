"""Sequence encoders for scoring windows of bars: small numpy forward passes over Arrow batches, with weights from outside.

Windows are gathered by Spark (``windows``), scored batch by batch (``score``); each task holds one batch and the weights.
Training is not part of this; ``random_weights`` makes weights of the right shapes for trials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.bars import KEYS, ORDER

Weights = dict[str, np.ndarray]
DILATIONS = (1, 2, 4, 8)


@dataclass(frozen=True)
class EncoderConfig:
    """model_type: lstm, tcn, patchtst or mamba. Inputs: value_channels, a vector of metadata_dim, mask and reason, time_channels."""

    model_type: str
    value_channels: int = 5
    metadata_dim: int = 4
    embedding_dim: int = 128
    time_channels: int = 1
    heads: int = 8
    layers: int = 2


def windows(bars: DataFrame, values: Sequence[str], length: int, every: int = 1) -> DataFrame:
    """Per full window: series keys, datetime of its last bar, steps (array of arrays: values, mask, reason, minutes since the bar before)."""
    series = Window.partitionBy(*KEYS).orderBy(ORDER)
    minutes = F.coalesce(F.timestamp_diff("MINUTE", F.lag(ORDER).over(series), F.col(ORDER)), F.lit(0)).cast("double")
    mask = F.col("features_mask").cast("double") if "features_mask" in bars.columns else F.lit(1.0)
    reason = F.col("features_reason").cast("double") if "features_reason" in bars.columns else F.lit(0.0)
    rows = bars.select(*KEYS, ORDER, F.row_number().over(series).alias("__row"), F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values], mask, reason, minutes).alias("__step"))
    steps = F.collect_list("__step").over(series.rowsBetween(-(length - 1), 0))
    return rows.withColumn("steps", steps).where((F.col("__row") >= length) & ((F.col("__row") - length) % every == 0)).select(*KEYS, ORDER, "steps")


def embed_metadata(df: DataFrame, table: DataFrame, key: str = "symbol") -> DataFrame:
    """Adds meta, the vector of ``key`` in a lookup table (key, meta); unknown ones have none and are scored as zeros."""
    return df.join(table.select(key, "meta"), key, "left")


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


_ERF = np.vectorize(math.erf)


def gelu(x):
    return 0.5 * x * (1.0 + _ERF(x / math.sqrt(2.0)))


def layer_norm(x, gain, bias, eps=1e-5):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gain + bias


def lstm(x: np.ndarray, w: Weights, layers: int = 2) -> np.ndarray:
    """x: batch, steps, channels. Gates in the order input, forget, cell, output. Returns the last hidden state."""
    for k in range(layers):
        h = c = np.zeros((len(x), w[f"hh{k}"].shape[1]))
        out = []
        for t in range(x.shape[1]):
            i, f, g, o = np.split(x[:, t] @ w[f"ih{k}"].T + h @ w[f"hh{k}"].T + w[f"b{k}"], 4, axis=1)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        x = np.stack(out, axis=1)
    return x[:, -1]


def causal_conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, dilation: int) -> np.ndarray:
    """kernel: out, in, width. What lies before the first step counts as zeros; no step sees a later one."""
    width = kernel.shape[2]
    padded = np.pad(x, ((0, 0), ((width - 1) * dilation, 0), (0, 0)))
    return sum((padded[:, j * dilation : j * dilation + x.shape[1]] @ kernel[:, :, j].T for j in range(width)), bias)


def tcn(x: np.ndarray, delta: np.ndarray, w: Weights, dilations: Sequence[int] = DILATIONS) -> np.ndarray:
    """Residual blocks whose convolutions are gated by the time since the step before."""
    x = x @ w["project"].T + w["project_b"]
    for k, d in enumerate(dilations):
        inner = gelu(causal_conv(x, w[f"conv{k}"], w[f"conv{k}_b"], d) * sigmoid(delta @ w[f"gate{k}"].T + w[f"gate{k}_b"]))
        x = layer_norm(x + inner, w[f"norm{k}"], w[f"norm{k}_b"])
    return x[:, -1]


def transformer(x: np.ndarray, absent: np.ndarray, w: Weights, heads: int = 8, layers: int = 3) -> np.ndarray:
    """Self-attention in which absent steps aren't looked at, unless all are. Returns the last step."""
    x = x @ w["project"].T + w["project_b"]
    n, steps, dim = x.shape
    hidden = np.where(absent & ~absent.all(axis=1, keepdims=True), -np.inf, 0.0)[:, None, None, :]
    for k in range(layers):
        q, key, v = (y.reshape(n, steps, heads, dim // heads).transpose(0, 2, 1, 3) for y in np.split(x @ w[f"qkv{k}"].T + w[f"qkv{k}_b"], 3, axis=2))
        score = q @ key.transpose(0, 1, 3, 2) / math.sqrt(dim // heads) + hidden
        score = np.exp(score - score.max(-1, keepdims=True))
        seen = (score / score.sum(-1, keepdims=True)) @ v
        x = layer_norm(x + seen.transpose(0, 2, 1, 3).reshape(n, steps, dim) @ w[f"out{k}"].T + w[f"out{k}_b"], w[f"norm{k}"], w[f"norm{k}_b"])
        x = layer_norm(x + np.maximum(x @ w[f"up{k}"].T + w[f"up{k}_b"], 0) @ w[f"down{k}"].T + w[f"down{k}_b"], w[f"fnorm{k}"], w[f"fnorm{k}_b"])
    return x[:, -1]


STATES, TAPS, EXPAND = 16, 4, 2


def silu(x):
    return x * sigmoid(x)


def linear_scan(keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """h[t] = keep[t] * h[t - 1] + add[t] along axis 1, from 0: pairs of steps are one step, so log2(steps) passes over all of them do."""
    keep, h, reach = keep.copy(), add.copy(), 1
    while reach < h.shape[1]:
        h[:, reach:] += keep[:, reach:] * h[:, :-reach].copy()
        keep[:, reach:] *= keep[:, :-reach].copy()
        reach *= 2
    return h


def _selected(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How much of the state each step keeps and what it adds (both by channel and state), and how the state is read out: all depend on the input."""
    rank = w["dt"].shape[1]
    delta, write, read = np.split(x @ w["select"].T, [rank, rank + STATES], axis=-1)
    delta = np.logaddexp(0.0, delta @ w["dt"].T + w["dt_b"])[..., None]
    return np.exp(-delta * np.exp(w["decay_log"])), delta * write[..., None, :] * x[..., None], read


def selective(x: np.ndarray, w: Weights, at_once: int = 16) -> np.ndarray:
    """A selective state space over steps: a gate and a short causal convolution for each channel, then a linear recurrence whose coefficients come from the input. ``at_once``: windows in memory with all their states."""
    out = []
    for i in range(0, len(x), at_once):
        inner, gate = np.split(x[i : i + at_once] @ w["enter"].T, 2, axis=-1)
        padded = np.pad(inner, ((0, 0), (TAPS - 1, 0), (0, 0)))
        inner = silu(sum(padded[:, j : j + inner.shape[1]] * w["taps"][:, j] for j in range(TAPS)) + w["taps_b"])
        keep, add, read = _selected(inner, w)
        y = np.einsum("btcs,bts->btc", linear_scan(keep, add), read) + w["skip"] * inner
        out.append((y * silu(gate)) @ w["leave"].T)
    return np.concatenate(out) if out else x


class Steps:
    """An encoder one bar at a time: ``state`` is what it remembers of a series, ``step`` takes the inputs of the next bar and returns the vector the window encoder gives for all bars so far."""

    def __init__(self, config: EncoderConfig, w: Weights):
        if config.model_type not in ("lstm", "tcn", "mamba"):
            raise ValueError(f"{config.model_type!r} looks at whole windows: lstm, tcn or mamba go step by step")
        self.config, self.w = config, w

    def shapes(self) -> dict[str, tuple[int, ...]]:
        dim, w = self.config.embedding_dim, self.w
        if self.config.model_type == "lstm":
            return {f"{n}{k}": (dim,) for k in range(self.config.layers) for n in "hc"}
        if self.config.model_type == "tcn":  # rings of the last inputs that each dilated convolution reaches
            return {f"ring{k}": ((w[f"conv{k}"].shape[2] - 1) * d, dim) for k, d in enumerate(DILATIONS)}
        return {"ring": (TAPS - 1, EXPAND * dim), "h": (EXPAND * dim, STATES)} if "enter" in w else {}

    def state(self) -> dict[str, np.ndarray]:
        return {k: np.zeros(shape) for k, shape in self.shapes().items()}

    def pack(self, state: dict[str, np.ndarray]) -> list[float]:
        return np.concatenate([np.zeros(0), *(x.ravel() for x in state.values())]).tolist()

    def unpack(self, numbers: list[float]) -> dict[str, np.ndarray]:
        sizes = [int(np.prod(shape)) for shape in self.shapes().values()]
        parts = np.split(np.asarray(numbers, dtype=float), np.cumsum(sizes)[:-1]) if sizes else []
        return {k: part.reshape(shape) for (k, shape), part in zip(self.shapes().items(), parts, strict=True)}

    def step(self, state: dict[str, np.ndarray], row: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """row: values, mask, reason, minutes. ``state`` is changed in place."""
        w, base, delta = self.w, np.concatenate([row[: self.config.value_channels], meta, row[-3:-1]]), row[-1:]
        if self.config.model_type == "lstm":
            x = base
            for k in range(self.config.layers):
                i, f, g, o = np.split(w[f"ih{k}"] @ x + w[f"hh{k}"] @ state[f"h{k}"] + w[f"b{k}"], 4)
                state[f"c{k}"] = sigmoid(f) * state[f"c{k}"] + sigmoid(i) * np.tanh(g)
                state[f"h{k}"] = x = sigmoid(o) * np.tanh(state[f"c{k}"])
            return x
        if self.config.model_type == "tcn":
            x = w["project"] @ base + w["project_b"]
            for k, d in enumerate(DILATIONS):
                seen = np.concatenate([state[f"ring{k}"], x[None]])
                state[f"ring{k}"] = seen[1:]
                inner = sum((w[f"conv{k}"][:, :, j] @ seen[j * d] for j in range(w[f"conv{k}"].shape[2])), w[f"conv{k}_b"])
                x = layer_norm(x + gelu(inner * sigmoid(w[f"gate{k}"] @ delta + w[f"gate{k}_b"])), w[f"norm{k}"], w[f"norm{k}_b"])
            return x
        x = w["project"] @ np.concatenate([base, delta]) + w["project_b"]
        if "enter" not in w:
            return x
        inner, gate = np.split(w["enter"] @ x, 2)
        seen = np.concatenate([state["ring"], inner[None]])
        state["ring"] = seen[1:]
        inner = silu((seen * w["taps"].T).sum(axis=0) + w["taps_b"])
        keep, add, read = _selected(inner, w)
        state["h"] = keep * state["h"] + add
        return w["leave"] @ ((state["h"] @ read + w["skip"] * inner) * silu(gate))


def forward(config: EncoderConfig, w: Weights, steps: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """steps: batch, length, values + mask + reason + minutes; meta: batch, metadata_dim. Returns batch, embedding_dim."""
    spread = np.repeat(meta[:, None, :], steps.shape[1], axis=1)
    values, mask, reason, delta = (steps[:, :, a:b] for a, b in ((0, config.value_channels), (-3, -2), (-2, -1), (-1, None)))
    base = np.concatenate([values, spread, mask, reason], axis=2)
    if config.model_type == "lstm":
        return lstm(base, w, config.layers)
    if config.model_type == "tcn":
        return tcn(base, delta, w)
    if config.model_type == "patchtst":
        return transformer(np.concatenate([base, delta], axis=2), mask[:, :, 0] == 0, w, config.heads, config.layers)
    if config.model_type == "mamba":  # without weights of its own the state-space layer is the identity
        x = np.concatenate([base, delta], axis=2) @ w["project"].T + w["project_b"]
        return (selective(x, w) if "enter" in w else x)[:, -1]
    raise ValueError(f"unknown model_type {config.model_type!r}: lstm, tcn, patchtst or mamba")


def random_weights(config: EncoderConfig, seed: int = 7, scan: bool = False) -> Weights:
    """Weights of the right shapes, small and the same for the same seed. ``scan``: mamba gets a state-space layer."""
    rng, dim = np.random.default_rng(seed), config.embedding_dim
    inputs = config.value_channels + config.metadata_dim + 2 + (config.time_channels if config.model_type in ("patchtst", "mamba") else 0)
    make = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[-1]), shape)
    if config.model_type == "lstm":
        return {k: v for i in range(config.layers) for k, v in ((f"ih{i}", make(4 * dim, inputs if i == 0 else dim)), (f"hh{i}", make(4 * dim, dim)), (f"b{i}", np.zeros(4 * dim)))}
    w = {"project": make(dim, inputs), "project_b": np.zeros(dim)}
    if config.model_type == "mamba" and scan:
        wide, rank = EXPAND * dim, -(-dim // 16)
        w |= {"enter": make(2 * wide, dim), "taps": make(wide, TAPS), "taps_b": np.zeros(wide), "select": make(rank + 2 * STATES, wide), "dt": make(wide, rank), "dt_b": rng.uniform(-5, -2, wide)}
        w |= {"decay_log": np.log(np.tile(np.arange(1.0, STATES + 1), (wide, 1))), "skip": np.ones(wide), "leave": make(dim, wide)}
    if config.model_type == "tcn":
        for i in range(4):
            w |= {f"conv{i}": rng.normal(0, 1 / math.sqrt(3 * dim), (dim, dim, 3)), f"conv{i}_b": np.zeros(dim), f"gate{i}": make(dim, config.time_channels), f"gate{i}_b": np.zeros(dim), f"norm{i}": np.ones(dim), f"norm{i}_b": np.zeros(dim)}
    if config.model_type == "patchtst":
        for i in range(config.layers):
            w |= {f"qkv{i}": make(3 * dim, dim), f"qkv{i}_b": np.zeros(3 * dim), f"out{i}": make(dim, dim), f"out{i}_b": np.zeros(dim), f"up{i}": make(4 * dim, dim), f"up{i}_b": np.zeros(4 * dim), f"down{i}": make(dim, 4 * dim), f"down{i}_b": np.zeros(dim)}
            w |= {f"{n}{i}": np.ones(dim) for n in ("norm", "fnorm")} | {f"{n}{i}_b": np.zeros(dim) for n in ("norm", "fnorm")}
    return w


def score(df: DataFrame, config: EncoderConfig, weights: Weights, out: str = "embedding") -> DataFrame:
    """``df`` (steps, and meta if there is any) with the encoder's vector for each row."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    if "meta" not in df.columns:
        df = df.withColumn("meta", F.lit(None).cast("array<double>"))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for steps, meta in batches:
            x = np.stack([np.stack(s) for s in steps])
            m = np.stack([np.zeros(config.metadata_dim) if v is None else np.asarray(v, dtype=float) for v in meta])
            yield pd.Series(list(forward(config, shared.value, x, m)))

    return df.withColumn(out, run("steps", "meta"))


def dense(df: DataFrame, column: str, weights: Weights, states: int, out: str = "transition") -> DataFrame:
    """The dynamic transition matrix of each row's vector on Arrow batches: for layers too wide for expressions."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<array<double>>")
    def run(vectors: pd.Series) -> pd.Series:
        w = shared.value
        logits = (gelu(np.stack(vectors) @ w["w1"].T + w["b1"]) @ w["w2"].T + w["b2"]).reshape(-1, states, states)
        powers = np.exp(logits - logits.max(-1, keepdims=True))
        return pd.Series([m.tolist() for m in powers / powers.sum(-1, keepdims=True)])

    return df.withColumn(out, run(column))


