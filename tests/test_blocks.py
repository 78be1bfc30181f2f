"""Series cut into buckets and blocks: the same results as whole series."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ops
from barloom.operators.buckets import carried, ranked
from barloom.plans.features import FeaturePlan, feature_table

START = dt.datetime(2024, 1, 1)
ROWS = "symbol string, timeframe string, datetime timestamp_ntz, open double, high double, low double, close double, volume double"


def gapped(seed=3, symbols=("a", "b", None), n=150, nulls=0.08):
    """Bars with gaps in time and nulls in every column, in any order."""
    rng, out = random.Random(seed), []
    for symbol in symbols:
        price, at = 100.0, START
        for i in range(n):
            at += dt.timedelta(hours=rng.choice([1, 1, 1, 2, 30]))
            price += 0.0 if 40 <= i < 60 else rng.uniform(-2, 2)
            bar = [price + rng.uniform(-1, 1), price + rng.uniform(0, 2), price - rng.uniform(0, 2), price, float(rng.randrange(0, 50))]
            out.append((symbol, "1h", at, *(None if rng.random() < nulls else x for x in bar)))
    rng.shuffle(out)
    return out


def same(a, b, keys=("symbol", "timeframe", "datetime")):
    a, b = (x.toPandas().sort_values(list(keys)).reset_index(drop=True) for x in (a, b))
    assert a.columns.tolist() == b.columns.tolist() and len(a) == len(b) > 0
    for c in a.columns:
        if c in keys:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


@pytest.mark.parametrize("span", ["1 hour", "3 days", "1000 days"])
def test_ranks_and_carried_values_by_buckets(spark, span):
    rows = gapped()
    df = spark.createDataFrame(rows, ROWS)
    got = {(r["symbol"], r["datetime"]): (r["n"], r["last"]) for r in ranked(carried(df, ["symbol"], "datetime", {"last": "close"}, span=span), ["symbol"], "datetime", "n", span).collect()}
    for symbol in ("a", "b", None):
        last = None
        for i, r in enumerate(sorted(r for r in rows if r[0] == symbol) if symbol else sorted((r for r in rows if r[0] is None), key=lambda r: r[2])):
            last = r[6] if r[6] is not None else last
            assert got[symbol, r[2]] == (i, last)
    assert len(got) == len(rows)
    assert ranked(df.where("false"), ["symbol"], "datetime", "n").count() == 0


@pytest.mark.parametrize("span", ["2 hours", "28 days"])
def test_latest_closed_by_the_loop(spark, span):
    base, wide = gapped(5, nulls=0.0), gapped(6, ("a", None, "z"), 40, 0.2)
    left = ops.with_close_time(spark.createDataFrame(base, ROWS), "1h").select("symbol", "datetime", "close", "close_time")
    right = ops.with_close_time(spark.createDataFrame(wide, ROWS), "1d")
    got = {(r["symbol"], r["datetime"]): (r["w_close_time"], r["w_close"]) for r in ops.latest_closed(left, right, "w_", ("close",), span).collect()}
    one, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    for r in base:
        before = [w for w in wide if w[0] == r[0] and w[2] + day <= r[2] + one]
        best = max(before, key=lambda w: w[2], default=None)
        assert got[r[0], r[2]] == ((best[2] + day - dt.timedelta(milliseconds=1), best[6]) if best else (None, None))


def test_no_window_holds_a_whole_symbol(spark):
    bars = ops.with_close_time(spark.createDataFrame(gapped(), ROWS), "1h")
    for df in (ops.latest_closed(bars, bars, "w_"), ops.after_warmup(bars, 10), ops.drop_unclosed(bars)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition" in line]
        assert all("__bucket" in line for line in windows), windows
    assert ops.drop_unclosed(bars).count() == 450 - 3


#: Every kind of column: bounded windows on both sides, averages, running sums and last values, row numbers, filters, stops, trends, kernels, sessions.
NAMES = ("RSI", "MACD", "Bollinger_Bands", "SuperTrend", "Chandelier_Exit", "Kalman_Filter", "OBV", "VWAP", "Hurst", "Order_Block", "Propagation", "Rolling_OBV_MACD", "SMC_Context", "Narrative")


def test_plans_by_blocks_equal_plans_by_series(spark):
    bars = spark.createDataFrame(gapped(), ROWS)
    plan = FeaturePlan(tuple((n, n) for n in NAMES), {"Hurst": {"window_size": 40, "max_sub_period": 20}})
    same(feature_table(bars, plan, keep=("close",), block_rows=37), feature_table(bars, plan, keep=("close",)))


def test_blocks_larger_than_the_series_and_no_rows(spark):
    bars = spark.createDataFrame(gapped(9, ("a",), 50), ROWS)
    plan = FeaturePlan((("RSI", "RSI"), ("SuperTrend", "SuperTrend")), warmup_bars=10)
    same(feature_table(bars, plan, block_rows=1000), feature_table(bars, plan))
    assert feature_table(bars.where("false"), plan, block_rows=8).count() == 0
    with pytest.raises(ValueError):
        feature_table(bars, plan, block_rows=0)


def test_a_long_series_is_many_tasks(spark):
    """The blocks of one series are spread over all partitions."""
    from barloom.plans import blocks
    from barloom.plans.features import columns_of, single

    bars = spark.createDataFrame(gapped(4, ("a",), 400), ROWS)
    b, out = columns_of(single("RSI"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one task
    try:
        df = blocks.add_to(b, bars, out, (), rows=25)
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
