"""Feature plans on running streams: as the same plan over the whole series, bar by bar as the watermark passes them.

Released bars of a micro-batch are a block of their series, see ``plans.blocks``. A stateful processor puts bars in order, numbers them, and brings along the last ones that the
plan's windows reach, from a ring in list state. The states of all recurrences are a few numbers for each series; each micro-batch reads the table of states that the
one before has written and writes its own, under its number, as it does with the features: done again after a failure, it writes the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.recurrences import KEYS, ORDER
from barloom.operators.buckets import seconds
from barloom.operators.indicators import INDICATORS
from barloom.plans import blocks
from barloom.plans.blocks import BLOCK, ROW, Step
from barloom.plans.features import FeaturePlan, columns_of
from barloom.sources.shared import kept
from barloom.streaming.ordered import AT, Ordered, frames, in_state, state_store, timed

FROM, TO = "__from", "__to"
SERIES = (*KEYS, BLOCK)


class Ring(Ordered):
    """Bars in order, with their numbers, after the ``back`` ones before those that get features now. Features wait for the ``ahead`` bars after them. A series that begins anew is another block."""

    def __init__(self, columns: dict[str, str], back: int, ahead: int, forget: int):
        super().__init__(columns, forget)
        self.back, self.ahead = back, ahead

    def init(self, handle):
        super().init(handle)
        self.ring = handle.getListState("ring", f"at long, {', '.join(f'{c} {k}' for c, k in self.columns.items())}")
        self.count = handle.getValueState("count", "n long, life long")

    def release(self, key, bars, passed) -> Iterator[pd.DataFrame]:
        if not bars:
            return
        before, life = self.count.get() if self.count.exists() else (0, 0)
        held = list(self.ring.get()) if self.ring.exists() else []
        rows, n = [*held, *bars], before + len(bars)
        own, to = max(0, before - self.ahead), max(0, n - self.ahead)
        first = before - len(held)
        yield from frames(key, [(row[0], life, first + i, own, to, *row[1:]) for i, row in enumerate(rows)], [AT, BLOCK, ROW, FROM, TO, *self.columns])
        left = rows[-(self.back + self.ahead) :] if self.back + self.ahead else []
        self.ring.put(left) if left else self.ring.clear()
        self.count.update((n, life))

    def forgotten(self):
        self.ring.clear()
        self.count.clear()

    def anew(self):
        life = self.count.get()[1] if self.count.exists() else 0
        self.ring.clear()
        self.count.update((0, life + 1))


def _advanced(df: DataFrame, states: DataFrame | None, found: list[Step], starts: list[int], reach: int) -> DataFrame:
    """``df``, whose rows of a series are one block, with the outputs of these recurrences, and the states at the next block's beginning in the series' last row (``__states``)."""
    scans = [x.scan for x in found]

    def finished(key: tuple, table: pa.Table, states: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        at, after = table.column(ROW).to_numpy(), []
        own, to = (table.column(x)[0].as_py() if len(at) else 0 for x in (FROM, TO))
        known = states.column("states").to_pylist()[0] if states.num_rows and own else [[]] * len(scans)
        for step, scan, back, state in zip(found, scans, starts, known, strict=True):
            xs, state = blocks._inputs(table, scan.inputs), scan.unpacked(state)
            if scan.reach is not None:
                table = blocks._outputs(table, step, 0, scan.run(None, *xs)[0])
                after.append([])
                continue
            start, cut = (int(x) for x in np.searchsorted(at, [max(0, own - reach + back), max(0, to - reach + back)]))
            outs = [np.zeros(0)] * len(step.names)
            if cut > start:
                outs, state = scan.run(state, *(x[start:cut] for x in xs))
            after.append(scan.packed(state))
            more = scan.run(state, *(x[cut:] for x in xs))[0] if len(at) > cut else [np.zeros(0)] * len(step.names)
            table = blocks._outputs(table, step, start, [np.concatenate(pair) for pair in zip(outs, more, strict=True)])
        kind = pa.list_(pa.list_(pa.float64()))
        last = [None] * (len(at) - 1) + [after] if len(at) else []
        return table.append_column("__states", pa.array(last, kind))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if states is None:
        states = df.sparkSession.createDataFrame([], f"{', '.join(f'{k} {kinds[k]}' for k in SERIES)}, states array<array<double>>")
    schema = ", ".join([*(f"`{n}` {k}" for n, k in kinds.items()), *(f"{n} double" for x in found for n in x.names), "__states array<array<double>>"])
    return df.groupBy(*SERIES).cogroup(states.groupBy(*SERIES)).applyInArrow(finished, schema)


def start_features(bars: DataFrame, plan: FeaturePlan, out: str, checkpoint: str, lateness: str = "5 minutes", raw: bool = True, keep: Iterable[str] | None = None, forget: str = "90 days", trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream that writes a plan's table for ``bars`` to folder ``out``, a part for each micro-batch; read it by ``features``.

    A bar appears when the watermark has passed it and the bars that its swings look ahead to; rows then are those of ``feature_table`` over the whole series. Series without bars
    for ``forget`` begin anew. Plans whose indicators need whole sessions or whole series are refused. ``bars`` is a stream; its bars of a series have different times.
    """
    if apart := [name for _, name in plan.entries if INDICATORS[name].tables]:
        raise ValueError(f"these need whole sessions or series: {', '.join(apart)}")
    b, outputs = columns_of(plan, raw, True, tuple(bars.columns))
    found = blocks.steps(b, outputs.values())
    if any(x.whole for x in found.values()):
        raise ValueError("windows over sessions have streams of their own: see streaming.sessions")
    reach, ahead = blocks.reaches(found, outputs)
    keep = list(dict.fromkeys([*KEYS, ORDER, *(bars.columns if keep is None else keep)]))
    named = {c: f"v{i}" for i, c in enumerate(c for c in bars.columns if c not in (*KEYS, ORDER))}  # any names may come
    rows, columns = in_state(bars.withColumnsRenamed(named), lateness)
    schema = f"{', '.join(f'{k} {bars.schema[k].dataType.simpleString()}' for k in KEYS)}, {AT} long, {BLOCK} long, {ROW} long, {FROM} long, {TO} long, {', '.join(f'{c} {k}' for c, k in columns.items())}"
    ordered = rows.groupBy(*KEYS).transformWithStateInPandas(Ring(columns, reach, ahead, seconds(forget)), schema, "Append", "eventTime")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        df = kept(timed(batch, bars).withColumnsRenamed({v: c for c, v in named.items()}))
        before = _states(spark, f"{checkpoint}/states", number - 1)
        fresh: list[DataFrame] = []

        def scan(df: DataFrame, depth: int, scans: list[Step], starts: list[int]) -> DataFrame:
            own = before.where(F.col("depth") == depth).select(*SERIES, "states") if before is not None else None
            done = kept(_advanced(df, own, scans, starts, reach))
            fresh.append(done.where("__states IS NOT NULL").select(*SERIES, F.lit(depth).alias("depth"), ORDER, F.col("__states").alias("states")))
            return blocks.typed(done.drop("__states"), scans)

        table = blocks.run(df, found, outputs, [*keep, ROW, BLOCK, FROM, TO], scan, lambda df, _: df)
        table.where(f"{ROW} >= {FROM} AND {ROW} < {TO}").drop(ROW, BLOCK, FROM, TO).write.mode("overwrite").parquet(f"{out}/batch={number}")
        _keep_states(spark, before, fresh, f"{checkpoint}/states", number, forget)

    with state_store(bars.sparkSession):
        return ordered.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _states(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The table of states after a micro-batch: series, depth, datetime of its last bar, states."""
    return spark.read.parquet(f"{folder}/{number}") if _exists(spark, f"{folder}/{number}") else None


def _keep_states(spark: SparkSession, before: DataFrame | None, fresh: list[DataFrame], folder: str, number: int, forget: str) -> None:
    """Writes the states after a micro-batch: new ones, and old ones of series that had no bars, unless these have been forgotten. The states of the last batch but one go."""
    if not fresh:
        return
    table = fresh[0]
    for more in fresh[1:]:
        table = table.unionByName(more)
    if before is not None:
        own = table.select(*(F.col(k).alias(f"own_{k}") for k in SERIES)).distinct()
        table = table.unionByName(before.join(own, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in SERIES], "left_anti"))
    table = kept(table)
    last = table.agg(F.max(ORDER)).first()[0]
    if last is not None:
        table = table.where(F.col(ORDER) >= F.lit(last) - F.expr(f"INTERVAL {forget}"))
    table.write.mode("overwrite").parquet(f"{folder}/{number}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def features(spark: SparkSession, out: str) -> DataFrame:
    """What streams have written so far."""
    return spark.read.parquet(out).drop("batch")
