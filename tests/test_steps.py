"""The selective state-space layer by its plain loop, and encoders that go bar by bar."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from barloom.operators import encoders
from barloom.operators.encoders import EncoderConfig, Steps
from barloom.streaming import scores
from test_blocks import START
from test_streams import Feed, appended, parts


def config_of(kind, dim=16):
    return EncoderConfig(kind, value_channels=3, metadata_dim=2, embedding_dim=dim, layers=2)


def selective_loop(x, w):
    """Step by step, channel by channel, from the definition."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    wide, rank, n = len(w["skip"]), w["dt"].shape[1], encoders.STATES
    h, history, out = np.zeros((wide, n)), [], []
    for step in x:
        both = w["enter"] @ step
        inner, gate = both[:wide], both[wide:]
        history.append(inner)
        u = np.zeros(wide)
        for c in range(wide):
            total = w["taps_b"][c]
            for j in range(encoders.TAPS):
                at = len(history) - encoders.TAPS + j
                total += w["taps"][c, j] * (history[at][c] if at >= 0 else 0.0)
            u[c] = total * sig(total)
        chosen = w["select"] @ u
        y = np.zeros(wide)
        for c in range(wide):
            delta = math.log1p(math.exp(float(w["dt"][c] @ chosen[:rank]) + w["dt_b"][c]))
            for k in range(n):
                h[c, k] = math.exp(-math.exp(w["decay_log"][c, k]) * delta) * h[c, k] + delta * chosen[rank + k] * u[c]
                y[c] += chosen[rank + n + k] * h[c, k]
            y[c] = (y[c] + w["skip"][c] * u[c]) * gate[c] * sig(gate[c])
        out.append(w["leave"] @ y)
    return np.array(out)


@pytest.mark.parametrize("steps", [1, 2, 3, 32, 37])
def test_selective_scan_by_the_loop(steps):
    w = encoders.random_weights(config_of("mamba", 8), scan=True)
    x = np.random.default_rng(steps).normal(size=(5, steps, 8))
    got = encoders.selective(x, w, at_once=2)
    np.testing.assert_allclose(got, [selective_loop(s, w) for s in x], rtol=1e-9, atol=1e-12)
    changed = x.copy()
    changed[:, -1] += 1
    np.testing.assert_array_equal(encoders.selective(changed, w)[:, :-1], encoders.selective(x, w)[:, :-1])  # no step sees a later one


def test_without_its_weights_the_layer_is_the_identity():
    config = config_of("mamba")
    w = encoders.random_weights(config)
    rows, meta = np.random.default_rng(0).normal(size=(4, 6, 6)), np.zeros((4, 2))
    base = np.concatenate([rows[:, -1, :3], meta, rows[:, -1, 3:]], axis=1)
    np.testing.assert_allclose(encoders.forward(config, w, rows, meta), base @ w["project"].T + w["project_b"])
    assert encoders.selective(np.zeros((0, 3, 16)), encoders.random_weights(config, scan=True)).shape == (0, 3, 16)


@pytest.mark.parametrize("kind,scan", [("lstm", False), ("tcn", False), ("mamba", True), ("mamba", False)])
def test_steps_equal_windows_of_all_bars(kind, scan):
    config = config_of(kind)
    w = encoders.random_weights(config, scan=scan)
    steps, rng = Steps(config, w), np.random.default_rng(4)
    rows, meta = rng.normal(size=(40, 6)), rng.normal(size=2)
    state = steps.state()
    for t in range(40):
        got = steps.step(state, rows[t], meta)
        np.testing.assert_allclose(got, encoders.forward(config, w, rows[None, : t + 1], meta[None])[0], rtol=1e-9, atol=1e-12)
        state = steps.unpack(steps.pack(state))


def test_transformers_do_not_go_step_by_step():
    with pytest.raises(ValueError):
        Steps(config_of("patchtst"), {})


@pytest.mark.parametrize("kind", ["lstm", "mamba"])
def test_scores_of_a_stream(spark, tmp_path, kind):
    """Two runs with late bars: the vector at each bar is that of the window of all bars so far."""
    config, rng = config_of(kind, 8), np.random.default_rng(7)
    w = encoders.random_weights(config, scan=True)
    rows = [(s, "1h", START + dt.timedelta(hours=int(h)), *(float(x) for x in rng.normal(size=3)), None if h % 9 == 0 else 1.0, float(h % 5)) for s in "ab" for h in np.flatnonzero(rng.random(60) < 0.8)]
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], 1.0, r[7]) for r in rows]
    pieces, settled = parts(rows)
    feed = Feed(spark, tmp_path, appended(lambda s: scores.live_scores(s, ["open", "high", "low"], config, w, "6 hours")))
    for piece in pieces:
        feed.give(piece)
    got = {(r["symbol"], r["datetime"]): r["embedding"] for r in feed.out().collect()}
    assert set(got) == {(r[0], r[2]) for r in rows if r[2] <= settled}
    for symbol in "ab":
        own = sorted(r for r in rows if r[0] == symbol)
        x = [[*r[3:6], 1.0, 0.0, (r[2] - own[i - 1][2]).total_seconds() // 60 if i else 0.0] for i, r in enumerate(own)]
        for i, r in enumerate(own):
            if r[2] <= settled:
                np.testing.assert_allclose(got[symbol, r[2]], encoders.forward(config, w, np.array([x[: i + 1]]), np.zeros((1, 2)))[0], rtol=1e-9, atol=1e-12)
