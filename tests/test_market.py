from __future__ import annotations

import math
from datetime import date, datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import plain
from barloom import queries as market
from barloom.operators import bars as ops
from barloom.operators import encoders, transitions
from barloom.operators.indicators import INDICATORS
from barloom.operators.indicators.profile import session_profiles, with_factors
from barloom.operators.indicators.registry import Params
from barloom.plans.features import feature_table, load_plan, plan_from, single, without_constants
from barloom.sources import lake

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test data are not here")


def ordered(df, *names):
    return [tuple(r[n] for n in names) for r in sorted(df.collect(), key=lambda r: (r["symbol"], r["datetime"]))]


def close(got, want, tol=1e-9):
    np.testing.assert_allclose([np.nan if x is None else x for x in got], [np.nan if x is None else x for x in want], atol=tol, rtol=tol, equal_nan=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def compare(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    keys = [c for c in ("symbol", "timeframe", "datetime", "cell", "event_id") if c in got.columns]
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (name, c, got[c][~same].head(), want[c][~same].head())


@pytest.mark.parametrize("name", ["bars_1h", "missingness", "resample", "session_grid", "daily_track", "asof_align", "epoch_times", "warmup", "lake_round_trip", "primitives", "transition_static", "stream_bars", "stream_rsi", "plan_lite", "plan_blocks", "plan_file", "local_bars", "session_lake", "session_lake_epochs", "missing_shares", "stream_missingness", "stream_sessions", "stream_levels", "stream_vwap"])
def test_queries_agree_with_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ["ind_rsi", "ind_supertrend", "ind_chandelier_exit", "ind_smc_context", "ind_kalman_filter", "ind_schaff_trend_cycle", "ind_global_context", "ind_vwap", "ind_volume_oscillator"])
def test_indicators_agree_with_sql(spark, duck, name):
    compare(spark, duck, name)


def test_every_query_has_a_name_of_its_own_and_the_entry_runs(spark):
    assert len(INDICATORS) == 62 and {f"ind_{n.lower()}" for n in INDICATORS} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 3 + 48


def test_rsi_and_supertrend_by_plain_loops(spark):
    rows = plain.walk(60)
    got = feature_table(spark.createDataFrame(rows, plain.BARS), single("RSI", period=5), features=False, keep=())
    close([x[0] for x in ordered(got, "rsi__rsi")], plain.rsi([r[6] for r in rows], 5))
    got = feature_table(spark.createDataFrame(rows, plain.BARS), single("SuperTrend", atr_len=7, multiplier=2.0), features=False, keep=())
    want = plain.supertrend(rows, 7, 2.0)
    close([x[0] for x in ordered(got, "supertrend__trend")], [w[0] for w in want])
    close([x[0] for x in ordered(got, "supertrend__direction")], [w[1] for w in want])


def test_bands_have_zeros_before_the_window_is_full(spark):
    rows = plain.walk(30)
    got = feature_table(spark.createDataFrame(rows, plain.BARS), single("Bollinger_Bands", period=10), features=False, keep=())
    closes = [r[6] for r in rows]
    mean, wide = plain.rolling(closes, 10, lambda w: sum(w) / 10), plain.rolling(closes, 10, plain.sd)
    close([x[0] for x in ordered(got, "bollinger_bands__upper")], [(m or 0.0) + 2 * (w or 0.0) for m, w in zip(mean, wide, strict=True)])


def test_pivots_and_what_they_know_in_time(spark):
    rows = plain.walk(80, 4)
    df = spark.createDataFrame(rows, plain.BARS)
    highs = [r[4] for r in rows]
    want = [int(3 <= i < 77 and all(highs[i] > highs[i - k] for k in (1, 2, 3)) and all(highs[i] >= highs[i + k] for k in (1, 2, 3))) for i in range(80)]
    got = feature_table(df, single("SMC_Context", p_left=3, p_right=3), features=False, keep=())
    assert [int(x[0] == 1) for x in ordered(got, "smc_context__pivots")] == want
    # with confirmed swings, features don't change when later rows are cut off
    for name, extra in (("BOS_CHOCH", {}), ("Trap", {}), ("Divergence", {})):
        plan = single(name, confirm_delay=True, **extra)
        whole = ordered(feature_table(df, plan, features=False, keep=()), f"{name.lower()}__event")
        part = ordered(feature_table(df.where(F.col("datetime") < datetime(2024, 1, 1) + timedelta(hours=50)), plan, features=False, keep=()), f"{name.lower()}__event")
        assert whole[:50] == part


CAUSAL = sorted(set(INDICATORS) - {"BOS_CHOCH", "Breakout_Confirmation", "Divergence", "Liquidity", "Propagation", "Resonance", "SMC_Context", "Trap", "PCA", "Volume_Profile"})


def test_features_stay_within_bounds_and_do_not_look_ahead(spark):
    rows = [(*r, 2.0 + i % 5, 3.0 - i % 7) for i, r in enumerate(plain.walk(70, 6))] + [(*r, 1.0, 1.0) for r in plain.flat(40)]
    df = spark.createDataFrame(rows, plain.BARS + ", series_b double, series_c double")
    plan = plan_from({"meta_features_plan": [{"id": n, "indicator": n} for n in ("RSI", "Stochastic", "Keltner_Channels", "VWAP", "Vortex", "Rolling_Correlation", "Efficiency", "Hurst")], "indicator_default_params": {"Hurst": {"window_size": 40, "max_sub_period": 20}}})
    got = feature_table(df, plan, raw=False)
    names = [c for c in got.columns if c.startswith("feat_")]
    for r in got.collect():
        assert all(r[c] is not None and math.isfinite(r[c]) and abs(r[c]) <= 6 for c in names)
    part = feature_table(df.where(F.col("datetime") < datetime(2024, 1, 3)), plan, raw=False)
    whole = {(r["symbol"], r["datetime"]): r for r in got.collect()}
    for r in part.collect():
        close([r[c] for c in names], [whole[r["symbol"], r["datetime"]][c] for c in names])


def test_bad_parameters_are_named():
    with pytest.raises(ValueError, match="period"):
        single("RSI", period=None) and feature_names("RSI", {"period": None})
    with pytest.raises(ValueError, match="momentum_p must be less"):
        feature_names("Flow_Context", {"momentum_p": 40})
    with pytest.raises(ValueError, match="unknown indicators"):
        single("Nope")


def feature_names(name, params):
    from barloom.plans.features import columns_of

    return columns_of(single(name, **params))


def test_plan_file(spark, tmp_path):
    path = tmp_path / "plan.yaml"
    path.write_text("phase1_window: {warmup_bars: 10}\ntimeframes: ['1h']\nindicator_default_params: {RSI: {source: close, period: 5}}\nmeta_features_plan:\n- {id: fast, indicator: RSI}\n- {id: slow, indicator: RSI, params: {period: 9}}\n")
    plan = load_plan(path)
    got = feature_table(spark.createDataFrame(plain.walk(30), plain.BARS), plan, raw=False)
    assert got.count() == 20 and {"fast__feat_rsi_bias_stable", "slow__feat_rsi_bias_stable"} <= set(got.columns)
    still = feature_table(spark.createDataFrame(plain.flat(30), plain.BARS), plan, raw=False)
    assert not [c for c in without_constants(still).columns if "feat_rsi_volatility" in c]


def test_session_profiles_by_the_loop(spark):
    rows = plain.walk(72, 8) + plain.flat(30) + [(*r[:7], 0.0) for r in plain.walk(20, 3, "z")]
    got = {(r["symbol"], r["session"]): (r["poc"], r["vah"], r["val"]) for r in session_profiles(spark.createDataFrame(rows, plain.BARS)).collect()}
    days = {(r[0], r[2].date()) for r in rows}
    assert set(got) == days
    for symbol, day in days:
        close(got[symbol, day], plain.day_profile([(r[4], r[5], r[7]) for r in rows if r[0] == symbol and r[2].date() == day]))


def test_factors_are_scaled_and_uncorrelated(spark):
    p = Params(INDICATORS["PCA"].defaults | {"n_components": 3})
    df = with_factors(spark.createDataFrame(plain.walk(300, 2) + plain.flat(10), plain.BARS), p)
    pcs = np.array([[r[f"__t_pc{k}"] for k in (1, 2, 3)] for r in df.where("symbol = 'a' AND __t_pc1 IS NOT NULL").collect()])
    assert len(pcs) == 300 - 33
    cov = np.cov(pcs.T, bias=True)
    assert abs(cov - np.diag(np.diag(cov))).max() < 1e-9 and math.isclose(np.trace(cov), 3.0, rel_tol=1e-9) and cov[0, 0] >= cov[1, 1] >= cov[2, 2]
    assert df.where("symbol = 'f' AND __t_pc1 IS NOT NULL").count() == 0


def test_grid_sessions_and_unclosed_bar(spark):
    rows = [("a", "1m", datetime(2024, 1, 1, 0, i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, float(i)) for i in (1, 2, 5)]
    got = ordered(ops.fill_grid(spark.createDataFrame(rows, plain.BARS), "1m"), "datetime", "close", "volume", "features_mask", "features_reason")
    assert [g[1:] for g in got] == [(2.5, 1.0, True, 0), (3.5, 2.0, True, 0), (3.5, 0.0, False, 3), (3.5, 0.0, False, 3), (6.5, 5.0, True, 0)]
    # 09:15 and 10:00 in Taipei: the slot before the first close is left out
    rows = [("t", "15m", datetime(2024, 1, 2, 1, 15), 1.0, 2.0, 0.5, 1.5, 3.0), ("t", "15m", datetime(2024, 1, 2, 2, 0), 2.0, 2.5, 1.0, 2.0, 4.0)]
    got = ordered(ops.fill_sessions(spark.createDataFrame(rows, plain.BARS)), "datetime", "open", "close", "features_reason")
    assert len(got) == 17 and got[1][1:] == (1.5, 1.5, 3) and got[0][0] == datetime(2024, 1, 2, 1, 15)
    assert ops.drop_unclosed(spark.createDataFrame(rows, plain.BARS)).count() == 1
    with pytest.raises(ValueError, match="no timeframe"):
        ops.interval("1x")


def test_latest_closed_bar_only(spark):
    base = ops.with_close_time(spark.createDataFrame(plain.walk(50), plain.BARS), "1h")
    day = ops.resample(base.select("symbol", "timeframe", "datetime", "open", "high", "low", "close", "volume"), "1d")
    got = ordered(ops.latest_closed(base, day, "d_", ("close",)), "datetime", "d_close_time")
    assert got[22][1] is None and got[23][1] == datetime(2024, 1, 1, 23, 59, 59, 999000) and got[46][1] == got[23][1] and got[47][1].date() == date(2024, 1, 2)


def test_slices_give_the_same_averages(spark):
    df = spark.createDataFrame(plain.walk(200), plain.BARS)
    plan = single("RSI", period=3, adapt_macro_p=3, adapt_micro_p=3, adapt_vol_p=3)
    whole = ordered(feature_table(df, plan), "rsi__rsi")
    cut = feature_table(ops.sliced(df, 60, 90), plan).where("not in_halo").withColumn("symbol", F.col("series"))
    close([x[0] for x in ordered(cut, "rsi__rsi")], [x[0] for x in whole], 1e-7)


def test_lake(spark, tmp_path):
    raw = spark.createDataFrame(plain.walk(100) + plain.walk(50, 2, "b"), plain.BARS).drop("timeframe")
    made = lake.continuous_lake(raw, ("4h", "1d"), "1h")
    lake.write_lake(made, str(tmp_path / "lake"))
    part = lake.read_lake(spark, str(tmp_path / "lake"), ["a"], "1h", start=datetime(2024, 1, 3), warmup_bars=5)
    assert part.count() == 52 + 5 and part.where("in_range").count() == 52
    lake.write_lake(made, str(tmp_path / "epochs"), epochs=True)
    assert dict(spark.read.parquet(str(tmp_path / "epochs")).dtypes)["datetime"] == "bigint"
    good, bad = lake.usable(raw.withColumn("high", F.when((F.col("symbol") == "b") & (F.col("volume") > 25), F.lit(-1.0)).otherwise(F.col("high"))))
    assert {r["symbol"] for r in bad.collect()} == {"b"} and {r["symbol"] for r in good.collect()} == {"a"}


def test_transitions(spark):
    one = spark.range(1).select(transitions.static_transition(3).alias("m"), transitions.frozen(transitions.static_transition(3), F.lit(None).cast("boolean"), 3).alias("f")).first()
    assert all(math.isclose(sum(r), 1.0) for r in one["m"]) and one["m"][0][0] > one["m"][0][1]
    assert one["f"] == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rng = np.random.default_rng(1)
    w = {"w1": rng.normal(size=(4, 6)), "b1": rng.normal(size=4), "w2": rng.normal(size=(9, 4)), "b2": rng.normal(size=9)}
    df = spark.createDataFrame([(rng.normal(size=6).tolist(),) for _ in range(5)], "x array<double>")
    both = encoders.dense(df, "x", w, 3).withColumn("native", transitions.dynamic_transition(F.col("x"), {k: v.tolist() for k, v in w.items()}, 3)).collect()
    for r in both:
        np.testing.assert_allclose(r["transition"], r["native"], atol=1e-5)
        np.testing.assert_allclose(np.sum(r["native"], axis=1), 1.0)


@pytest.mark.parametrize("kind", ["lstm", "tcn", "patchtst", "mamba"])
def test_encoders_see_the_past_only(kind):
    config = encoders.EncoderConfig(kind, value_channels=2, metadata_dim=1, embedding_dim=8, heads=2, layers=2)
    w, rng = encoders.random_weights(config), np.random.default_rng(2)
    steps, meta = rng.normal(size=(3, 12, 5)), rng.normal(size=(3, 1))
    steps[:, :, -3] = 1.0
    whole = encoders.forward(config, w, steps, meta)
    assert whole.shape == (3, 8) and np.isfinite(whole).all()
    np.testing.assert_allclose(encoders.forward(config, w, steps[1:2], meta[1:2]), whole[1:2])
    with pytest.raises(ValueError, match="unknown model_type"):
        encoders.forward(encoders.EncoderConfig("gru"), w, steps, meta)


def test_causal_convolution_by_the_loop():
    rng = np.random.default_rng(3)
    x, kernel, bias = rng.normal(size=(2, 9, 3)), rng.normal(size=(4, 3, 3)), rng.normal(size=4)
    got = encoders.causal_conv(x, kernel, bias, 2)
    for t in range(9):
        want = bias + sum(x[0, t - (2 - j) * 2] @ kernel[:, :, j].T for j in range(3) if t - (2 - j) * 2 >= 0)
        np.testing.assert_allclose(got[0, t], want)


def test_empty_bars(spark):
    empty = spark.createDataFrame([], plain.BARS)
    assert feature_table(empty, market.LITE).count() == 0 and ops.fill_grid(empty, "1h").count() == 0
