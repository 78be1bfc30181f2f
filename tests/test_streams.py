"""Streams in several micro-batches with late bars, against the same over whole tables; what state they keep."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ops
from barloom.operators.indicators.profile import session_profiles
from barloom.plans.features import FeaturePlan, feature_table, single
from barloom.streaming import features, grids, sessions
from barloom.streaming.ordered import state_store
from test_blocks import ROWS, START, gapped

LATE = "6 hours"


class Feed:
    """Parts of a table handed to a stream one after the other, each in a run of its own over the same checkpoint."""

    def __init__(self, spark, folder, start):
        self.spark, self.folder, self.start, self.states = spark, str(folder), start, []

    def give(self, rows):
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        query = self.start(self.spark.readStream.schema(ROWS).parquet(f"{self.folder}/in"), self.folder)
        query.awaitTermination()
        self.states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out").drop("batch")  # parts of plans


def appended(transform):
    def start(stream, folder):
        with state_store(stream.sparkSession):
            return transform(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")

    return start


def parts(rows):
    """Two parts by time; the second begins with bars that the watermark of the first hasn't passed, in any order. Then the time up to which all is settled."""
    times = sorted(r[2] for r in rows)
    middle = times[len(times) // 2]
    late = {id(r) for r in rows if middle - dt.timedelta(hours=5) < r[2] <= middle and r[6] is not None and int(r[6] * 1000) % 2 and r[2] != middle}
    first = [r for r in rows if r[2] <= middle and id(r) not in late]
    return [first, [r for r in rows if r[2] > middle or id(r) in late]], times[-1] - dt.timedelta(hours=6)


def compared(got, want, settled=None):
    """All of got is in want, with equal values; returns the rows of want that aren't there yet."""
    keys = [c for c in ("symbol", "timeframe", "datetime", "session") if c in got.columns]
    got, want = got.toPandas(), want.toPandas()
    assert sorted(got.columns) == sorted(want.columns) and not got.duplicated(keys).any()
    both = got.merge(want, on=keys, how="outer", suffixes=("", "__w"), indicator=True)
    assert not (both["_merge"] == "left_only").any()
    here = both[both["_merge"] == "both"]
    for c in set(want.columns) - set(keys):
        np.testing.assert_allclose(here[c].astype(float), here[f"{c}__w"].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
    return both[both["_merge"] == "right_only"]


def test_grid_of_a_stream(spark, tmp_path):
    rows = gapped(2, ("a", "b"), 80)
    pieces, settled = parts(rows)
    feed = Feed(spark, tmp_path, appended(lambda s: grids.live_grid(s, "1h", LATE)))
    for piece in pieces:
        feed.give(piece)
    whole = ops.fill_grid(spark.createDataFrame(rows, ROWS), "1h")
    got, lasts = feed.out(), {}
    for r in rows:
        lasts[r[0]] = max(lasts.get(r[0], START), r[2])
    ends = F.create_map(*[F.lit(x) for k, v in lasts.items() for x in (k or "none", v)])
    own = F.element_at(ends, F.coalesce("symbol", F.lit("none")))
    missing = compared(got.where(F.col("datetime") <= own), whole)
    assert (missing["datetime"] > settled).all()
    beyond = got.where(F.col("datetime") > own).collect()  # series that have ended are filled up to the watermark
    assert beyond and all(r["features_reason"] == 3 and r["datetime"] <= settled for r in beyond)
    assert {r[0]: r[1] for r in got.groupBy("symbol").agg(F.max("datetime")).collect()} == {k: settled.replace(minute=0) for k in lasts}


def test_a_silent_series_is_forgotten(spark, tmp_path):
    bar = lambda symbol, hour: (symbol, "1h", START + dt.timedelta(hours=hour), 1.0, 2.0, 0.5, float(hour), 3.0)
    feed = Feed(spark, tmp_path, appended(lambda s: grids.live_grid(s, "1h", "1 hour", "10 hours")))
    feed.give([bar("a", 0), bar("a", 2), bar("b", 0)])
    feed.give([bar("b", 9)])
    held = feed.states[-1]
    feed.give([bar("b", 30)])
    feed.give([bar("b", 32), bar("a", 31), bar("a", 12)])  # the last comes too late
    hours = lambda symbol: sorted(int((r["datetime"] - START).total_seconds() // 3600) for r in feed.out().where(F.col("symbol") == symbol).collect())
    assert hours("a") == [*range(13), 31]  # ten hours beyond its last bar, then anew
    assert hours("b") == [*range(20), 30, 31]
    assert feed.states[2] < held


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(s, "15m", t, o, h, lo, c, v) for s, _, t, o, h, lo, c, v in gapped(7, ("a", "b"), 120, 0.1)]
    rows = [(*r[:2], r[2].replace(hour=1 + r[2].hour % 4, minute=15 * (i % 4)), *r[3:]) for i, r in enumerate(rows)]
    rows = list({(r[0], r[2]): r for r in rows}.values())
    pieces, _ = parts(rows)
    feed = Feed(spark, tmp_path, appended(lambda s: grids.live_sessions(s, lateness=LATE)))
    for piece in pieces:
        feed.give(piece)
    missing = compared(feed.out(), ops.fill_sessions(spark.createDataFrame(rows, ROWS)))
    assert set(missing["datetime"].dt.date) <= {max(r[2] for r in rows).date()}


@pytest.mark.parametrize("names", [("SuperTrend", "Chandelier_Exit", "Kalman_Filter", "Order_Block", "OBV", "Hurst"), ("RSI", "SMC_Context", "Bollinger_Bands")])
def test_plans_of_a_stream(spark, tmp_path, names):
    """Averages, running sums, stops, filters, kernels, swings that look ahead: over two runs as over the whole table."""
    rows = gapped(8, ("a", "b", None), 100)
    pieces, settled = parts(rows)
    plan = FeaturePlan(tuple((n, n) for n in names), {"Hurst": {"window_size": 30, "max_sub_period": 15}})
    feed = Feed(spark, tmp_path, lambda s, f: features.start_features(s, plan, f"{f}/out", f"{f}/state", LATE, keep=("close",)))
    for piece in pieces:
        feed.give(piece)
    missing = compared(feed.out(), feature_table(spark.createDataFrame(rows, ROWS), plan, keep=("close",)))
    waiting = missing[missing["datetime"] <= settled].groupby("symbol", dropna=False).size()
    assert (waiting <= 10).all() and len(missing) < 60  # bars after the watermark, and those that wait for bars after them


def test_plans_begin_anew_after_a_silence(spark, tmp_path):
    """Whether the silence is over in the same micro-batch, in the next, or has been noticed before."""
    bar = lambda hour: ("a", "1h", START + dt.timedelta(hours=hour), 1.0, 9.0, 0.5, float(hour % 7), 3.0)
    feed = Feed(spark, tmp_path, lambda s, f: features.start_features(s, single("RSI", period=3), f"{f}/out", f"{f}/state", "1 hour", keep=("close",), forget="20 hours"))
    lives = [range(0, 8), range(40, 46), range(90, 96), range(150, 156)]
    feed.give([bar(h) for h in [*lives[0], *lives[1][:3]]])
    feed.give([bar(h) for h in [*lives[1][3:], *lives[2][:1]]])
    feed.give([bar(h) for h in lives[2][1:]] + [("b", *bar(140)[1:])])
    feed.give([bar(h) for h in lives[3]])
    got = feed.out().where("symbol = 'a'").orderBy("datetime").collect()
    want = [r for life in lives for r in feature_table(spark.createDataFrame([bar(h) for h in life], ROWS), single("RSI", period=3), keep=("close",)).orderBy("datetime").collect()]
    names = [c for c in want[0].asDict() if c.startswith(("rsi", "feat"))]
    assert [r["datetime"] for r in got] == [r["datetime"] for r in want][:-1]
    for a, b in zip(got, want, strict=False):
        np.testing.assert_allclose([a[c] for c in names], [b[c] for c in names], rtol=1e-9, atol=1e-9)


def test_plans_that_streams_refuse(spark, tmp_path):
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path))
    for name in ("Volume_Profile", "VWAP"):
        with pytest.raises(ValueError):
            features.start_features(stream, single(name), "/tmp/none", "/tmp/none")


def test_average_price_of_the_day(spark, tmp_path):
    rows = gapped(11, ("a", None), 100)
    pieces, settled = parts(rows)
    feed = Feed(spark, tmp_path, appended(lambda s: sessions.live_vwap(s, lateness=LATE)))
    for piece in pieces:
        feed.give(piece)
    whole = feature_table(spark.createDataFrame(rows, ROWS), single("VWAP"), features=False, keep=("close",))
    whole = whole.withColumnsRenamed({c: c.removeprefix("vwap__") for c in whole.columns})
    got = feed.out()
    missing = compared(got.withColumnsRenamed({c: c.lower() for c in got.columns}), whole)
    assert (missing["datetime"] > settled).all()
    feed.give([("c", "1h", START + dt.timedelta(days=400), 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert feed.states[-1] < feed.states[-2]  # totals of days that are over are gone


def test_profiles_of_days(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for symbol in ("a", "b"):
        for i in range(120):
            low = float(rng.uniform(10, 20))
            rows.append((symbol, "1h", START + dt.timedelta(hours=i), low, low + float(rng.uniform(0.1, 4)), low, low, float(rng.uniform(1, 9))))
    rows += [("flat", "1h", START + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 2.0) for i in range(3)] + [("gap", "1h", START, None, None, None, None, None)]
    pieces, settled = parts(rows)
    feed = Feed(spark, tmp_path, appended(lambda s: sessions.live_profiles(s, lateness=LATE)))
    for piece in pieces:
        feed.give(piece)
    missing = compared(feed.out(), session_profiles(spark.createDataFrame(rows, ROWS)))
    assert set(missing["session"].astype(str)) == {"2024-01-05"}
    feed.give([("c", "1h", START + dt.timedelta(days=400), 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert feed.states[-1] < feed.states[-2]
