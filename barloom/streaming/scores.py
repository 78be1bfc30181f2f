"""Encoders on running streams: what each remembers of a series is in state, and every bar costs one step."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import KEYS, ORDER
from barloom.operators.buckets import seconds
from barloom.operators.encoders import EncoderConfig, Steps, Weights
from barloom.sources.lake import qualified
from barloom.sources.shared import scratch
from barloom.streaming.ordered import AT, Ordered, frames, in_state, timed


class Scored(Ordered):
    """State besides what waits: the encoder's memory and the time of the last bar. Weights are read from a file, as broadcasts don't reach stateful processors."""

    def __init__(self, config: EncoderConfig, weights: str, values: int, forget: int):
        super().__init__({**{f"x{i}": "double" for i in range(values)}, "mask": "double", "reason": "double", "meta": "array<double>"}, forget)
        self.config, self.weights, self.values = config, weights, values

    def init(self, handle):
        super().init(handle)
        store, path = fs.FileSystem.from_uri(self.weights)
        with store.open_input_file(path) as file, np.load(io.BytesIO(file.read())) as found:
            self.steps = Steps(self.config, dict(found))
        self.memory = handle.getValueState("memory", "at long, numbers array<double>")

    def release(self, key, bars, passed) -> Iterator[pd.DataFrame]:
        if not bars:
            return
        last, numbers = self.memory.get() if self.memory.exists() else (None, None)
        state, out = self.steps.state() if numbers is None else self.steps.unpack(numbers), []
        for at, *row, meta in bars:
            minutes = 0.0 if last is None else float((at - last) // 60_000_000)
            own = np.zeros(self.config.metadata_dim) if meta is None else np.asarray(meta, dtype=float)
            out.append((at, self.steps.step(state, np.array([*(0.0 if x is None else x for x in row), minutes]), own).tolist()))
            last = at
        self.memory.update((last, self.steps.pack(state)))
        yield from frames(key, out, [AT, "embedding"])

    def forgotten(self):
        self.memory.clear()


def live_scores(bars: DataFrame, values: Sequence[str], config: EncoderConfig, weights: Weights, lateness: str = "5 minutes", forget: str = "90 days") -> DataFrame:
    """The encoder's vector at each bar that the watermark has passed, of all bars of the series so far: as ``encoders.score`` gives for a window of them all.

    ``bars`` may have features_mask, features_reason and meta (array of double). Start the stream within ``ordered.state_store``.
    """
    optional = lambda c, usual: (F.col(c) if c in bars.columns else F.lit(usual)).cast("double")
    meta = F.col("meta") if "meta" in bars.columns else F.lit(None).cast("array<double>")
    named = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, v in enumerate(values)]
    rows, _ = in_state(bars.select(*KEYS, ORDER, *named, optional("features_mask", 1.0).alias("mask"), optional("features_reason", 0.0).alias("reason"), meta.alias("meta")), lateness)
    Steps(config, weights)  # a kind that can't go step by step is refused here
    file = f"{qualified(bars.sparkSession, scratch(bars.sparkSession))}/weights.npz"
    store, path = fs.FileSystem.from_uri(file)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with io.BytesIO() as held, store.open_output_stream(path) as out:
        np.savez(held, **weights)
        out.write(held.getvalue())
    scored = rows.groupBy(*KEYS).transformWithStateInPandas(Scored(config, file, len(values), seconds(forget)), f"symbol string, timeframe string, {AT} long, embedding array<double>", "Append", "eventTime")
    return timed(scored, bars)
