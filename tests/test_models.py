"""The registered encoders and transitions: every window and every component, at the full sizes, against plain loops."""

from __future__ import annotations

import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from barloom import queries as market
from barloom.operators import encoders

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test data are not here")
HEADS, DIM = 8, 128


def sigmoid(v):
    return 1 / (1 + math.exp(-v)) if v > -700 else 0.0


def gelu(v):
    return 0.5 * v * (1 + math.erf(v / math.sqrt(2)))


def norm(v, gain, bias):
    mean = sum(v) / len(v)
    return np.array([(x - mean) / math.sqrt(sum((y - mean) ** 2 for y in v) / len(v) + 1e-5) for x in v]) * gain + bias


def lstm(x, w):
    for k in range(2):
        h, c, out = np.zeros(DIM), np.zeros(DIM), []
        for step in x:
            z = w[f"ih{k}"] @ step + w[f"hh{k}"] @ h + w[f"b{k}"]
            c = np.array([sigmoid(z[DIM + j]) * c[j] + sigmoid(z[j]) * math.tanh(z[2 * DIM + j]) for j in range(DIM)])
            h = np.array([sigmoid(z[3 * DIM + j]) * math.tanh(c[j]) for j in range(DIM)])
            out.append(h)
        x = out
    return x[-1]


def tcn(x, minutes, w):
    x = [w["project"] @ step + w["project_b"] for step in x]
    for k, d in enumerate((1, 2, 4, 8)):
        out = []
        for t in range(len(x)):
            z = w[f"conv{k}_b"] + sum(w[f"conv{k}"][:, :, j] @ x[t - (2 - j) * d] for j in range(3) if t >= (2 - j) * d)
            gate = w[f"gate{k}"] @ [minutes[t]] + w[f"gate{k}_b"]
            out.append(norm(x[t] + np.array([gelu(a * sigmoid(g)) for a, g in zip(z, gate, strict=True)]), w[f"norm{k}"], w[f"norm{k}_b"]))
        x = out
    return x[-1]


def patchtst(x, present, w):
    x, size = [w["project"] @ step + w["project_b"] for step in x], DIM // HEADS
    seen = [s for s in range(len(x)) if present[s]] or list(range(len(x)))
    for k in range(3):
        qkv, out = [w[f"qkv{k}"] @ step + w[f"qkv{k}_b"] for step in x], []
        for t in range(len(x)):
            heads = []
            for h in range(HEADS):
                q, key, v = (slice(part * DIM + h * size, part * DIM + (h + 1) * size) for part in range(3))
                score = [float(qkv[t][q] @ qkv[s][key]) / math.sqrt(size) for s in seen]
                power = [math.exp(a - max(score)) for a in score]
                heads.append(sum(a * qkv[s][v] for a, s in zip(power, seen, strict=True)) / sum(power))
            y = norm(x[t] + w[f"out{k}"] @ np.concatenate(heads) + w[f"out{k}_b"], w[f"norm{k}"], w[f"norm{k}_b"])
            up = np.array([max(a, 0.0) for a in w[f"up{k}"] @ y + w[f"up{k}_b"]])
            out.append(norm(y + w[f"down{k}"] @ up + w[f"down{k}_b"], w[f"fnorm{k}"], w[f"fnorm{k}_b"]))
        x = out
    return x[-1]


@pytest.mark.parametrize("kind", ["lstm", "tcn", "patchtst", "mamba"])
def test_encoders_score_every_window(spark, kind):
    got = {(r["symbol"], r["datetime"]): r["embedding"] for r in market.queries()[f"encoder_{kind}"](spark, SF).collect()}
    series = defaultdict(list)
    for r in sorted(market.filled_bars(spark, SF).collect(), key=lambda r: (r["symbol"], r["datetime"])):
        series[r["symbol"]].append(r)
    assert set(got) == {(s, r["datetime"]) for s, rows in series.items() for r in rows[31:]} and got
    config = encoders.EncoderConfig(kind, value_channels=5, metadata_dim=2, embedding_dim=DIM, heads=HEADS, layers=3 if kind == "patchtst" else 2)
    w = encoders.random_weights(config)
    meta = {"click": [1.0, 0.0], "view": [0.0, 1.0]}
    for symbol, rows in series.items():
        for last in {32, len(rows) - 1}:  # the second window, and the last
            x, present, minutes = [], [], []
            for i in range(last - 31, last + 1):
                r, gap = rows[i], (rows[i]["datetime"] - rows[i - 1]["datetime"]).total_seconds() // 60 if i else 0.0
                base = [r[c] or 0.0 for c in ("open", "high", "low", "close", "volume")] + meta.get(symbol, [0.0, 0.0]) + [float(r["features_mask"]), float(r["features_reason"])]
                x.append(np.array(base + ([gap] if kind in ("patchtst", "mamba") else [])))
                present.append(bool(r["features_mask"]))
                minutes.append(gap)
            want = lstm(x, w) if kind == "lstm" else tcn(x, minutes, w) if kind == "tcn" else patchtst(x, present, w) if kind == "patchtst" else w["project"] @ x[-1] + w["project_b"]
            np.testing.assert_allclose(got[symbol, rows[last]["datetime"]], want, atol=1e-5)


def test_transitions_see_every_component(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]]
    w = market._fixed_weights(64, 64, 3)
    got = defaultdict(dict)
    for r in market.queries()["transition_dynamic"](spark, SF).collect():
        got[r["vec_id"]][r["cell"]] = r["p"]
    assert set(got) == {r["vec_id"] for r in rows}
    for r in rows[:40]:
        hidden = [gelu(sum(a * v for a, v in zip(row, r["embedding"], strict=True)) + b) for row, b in zip(w["w1"], w["b1"], strict=True)]
        logits = [sum(a * h for a, h in zip(row, hidden, strict=True)) + b for row, b in zip(w["w2"], w["b2"], strict=True)]
        for i in range(3):
            powers = [math.exp(v) for v in logits[3 * i : 3 * i + 3]]
            for j in range(3):
                assert abs(got[r["vec_id"]][3 * i + j] - powers[j] / sum(powers)) <= 6e-5
