"""Columns of the caller's table whose names look like a plan's own."""

from __future__ import annotations

from datetime import datetime, timedelta

from barloom.plans.features import feature_table, single


def test_clashing_columns_stay_as_they_are(spark):
    rows = [("A", "1h", datetime(2024, 1, 1) + timedelta(hours=i), 10.0 + i % 7, 11.0 + i % 7, 9.0 + i % 7, 10.0 + i % 5, 5.0, f"x{i}", float(i)) for i in range(40)]
    names = "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double"
    odd = spark.createDataFrame(rows, f"{names}, c_0 string, C__1 double")
    plain = odd.drop("c_0", "C__1")
    got, want = (feature_table(x, single("RSI", period=5)).orderBy("datetime").collect() for x in (odd, plain))
    assert [r["c_0"] for r in got] == [f"x{i}" for i in range(40)]
    assert [r["C__1"] for r in got] == [float(i) for i in range(40)]
    assert [{k: v for k, v in r.asDict().items() if k not in ("c_0", "C__1")} for r in got] == [r.asDict() for r in want]


def test_profiles_and_factors_leave_columns_alone(spark):
    rows = [("A", "1h", datetime(2024, 1, 1) + timedelta(hours=i), 10.0 + i % 7, 11.0 + i % 7, 9.0 + i % 7, 10.0 + i % 5, 5.0 + i % 3, f"x{i}", i, 1.0) for i in range(60)]
    odd = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, t_poc string, session int, t_f0 double")
    for name in ("Volume_Profile", "PCA"):
        got = feature_table(odd, single(name)).orderBy("datetime").collect()
        want = feature_table(odd.drop("t_poc", "session", "t_f0"), single(name)).orderBy("datetime").collect()
        assert [(r["t_poc"], r["session"], r["t_f0"]) for r in got] == [r[8:] for r in rows]
        assert [{k: v for k, v in r.asDict().items() if k not in ("t_poc", "session", "t_f0")} for r in got] == [r.asDict() for r in want]
