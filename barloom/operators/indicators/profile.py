"""Profiles, spectra and factors: what needs sessions, wide windows or a fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import sql as s
from barloom.functions.recurrences import KEYS
from barloom.functions.rolling import DominantPeriod, HurstExponent, ProfileShape
from barloom.functions.series import change
from barloom.operators.indicators.registry import around, axis, channel, from_mean, indicator, relative, rough
from barloom.plans.frame import Columns

HALF_LOG, HALF, TWO = ((0.0, 0.5), (0.0, 1.0)), ((-0.5, 0.5), (-1.0, 1.0)), ((-1.0, 1.0), (-2.0, 2.0))
BINS, SHARE = 24, 0.7


@indicator("Hurst", "scalar", "feat_hurst", around("feat_hurst", lambda h, p: f"({h['Hurst']} - 5e-1) * 2e0", ((-1.0, 1.0), (-1.0, 1.0)), HALF, HALF_LOG, "window_size", 5, 34), input_feature="close", window_size=100, min_sub_period=10, max_sub_period=50)
def hurst(b, p):
    return {"Hurst": b.scan(HurstExponent, [b.forward(p.input_feature)], p.window_size, p.min_sub_period, p.max_sub_period)[0]}


def _spectral_value(h, p):
    return f"{s.guarded(h['DominantPeriod'] + ' - ' + s.num(float(p.min_period)), s.num(float(p.max_period - p.min_period)), s.FEATURE_EPS)} * 2e0 - 1e0"


@indicator("Spectral", "scalar", "feat_spectral", around("feat_spectral", _spectral_value, ((-1.0, 1.0), (-1.2, 1.2)), TWO, HALF_LOG, "window_size", 5, 34), input_feature="close", window_size=100, min_period=10, max_period=50)
def spectral(b, p):
    return {"DominantPeriod": b.scan(DominantPeriod, [b.forward(p.input_feature)], p.window_size, p.min_period, p.max_period)[0]}


def _shape_features(b, h, p):
    x, macro = h["ProfileShape"], p.get("adapt_macro_p", 55)
    return axis(b, "feat_vp_geo_position", b.ewm(x, macro), (-0.8, 0.8), (-1.0, 1.0)) | axis(b, "feat_vp_geo_bias", from_mean(b, x, macro), *TWO) | axis(b, "feat_vp_geo_momentum", relative(b, x, p.get("adapt_micro_p", 13)), (-1.0, 1.0), (-5.0, 5.0)) | axis(b, "feat_vp_geo_volatility", rough(b, x, p.get("adapt_vol_p", p.window_size)), *HALF_LOG)


@indicator("Volume_Profile_Geometry", "event", "feat_vp_geo", _shape_features, window_size=50, bins=24, va_pct=0.7)
def profile_geometry(b, p):
    return {"ProfileShape": b.scan(ProfileShape, ["high", "low", "volume"], p.window_size, p.bins, p.va_pct)[0]}


def session_profiles(bars: DataFrame, bins: int = BINS, share: float = SHARE) -> DataFrame:
    """Per symbol, timeframe and day: poc, vah, val. Volume is spread evenly over the bins that a bar touches.

    Grouped by day and bin before anything is gathered, so no task holds more than ``bins`` numbers for a day.
    Days without a range or without volume have their middle, highest and lowest price.
    """
    keys = [*KEYS, "session"]
    rows = bars.select(*KEYS, F.to_date("datetime").alias("session"), "high", "low", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    day = rows.groupBy(*keys).agg(F.min("low").alias("bottom"), F.max("high").alias("top"))
    size = (F.col("top") - F.col("bottom")) / bins
    placed = rows.join(day, keys).where((F.col("top") - F.col("bottom") >= 1e-9) & (F.col("volume") != 0)).withColumn("size", size)
    first = F.greatest(F.lit(0), F.try_divide(F.col("low") - F.col("bottom"), "size").cast("int"))
    last = F.least(F.lit(bins - 1), F.try_divide(F.col("high") - F.col("bottom"), "size").cast("int"))
    placed = placed.select(*keys, "volume", first.alias("first"), last.alias("last")).where("last >= first")  # a bar at the very top may touch no bin
    spread = placed.select(*keys, F.explode(F.sequence("first", "last")).alias("bin"), F.try_divide("volume", F.col("last") - F.col("first") + 1).alias("part"))
    filled = spread.groupBy(*keys, "bin").agg(F.sum("part").alias("part"))
    profile = filled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "part"))).alias("by_bin"))
    profile = profile.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0.0))).alias("profile"))
    total = F.aggregate("profile", F.lit(0.0), lambda acc, x: acc + x)
    peak = (F.array_position("profile", F.array_max("profile")) - 1).cast("int")
    at = lambda i: F.get("profile", i)

    def grown(acc, _):
        above = F.when(acc["high"] < bins - 1, at(acc["high"] + 1)).otherwise(-1.0)
        below = F.when(acc["low"] > 0, at(acc["low"] - 1)).otherwise(-1.0)
        more = (acc["held"] < F.col("total") * share) & ((acc["low"] > 0) | (acc["high"] < bins - 1))
        up = more & (above > below)
        down = more & ~(above > below)
        return F.struct((acc["low"] - F.when(down, 1).otherwise(0)).alias("low"), (acc["high"] + F.when(up, 1).otherwise(0)).alias("high"), (acc["held"] + F.when(up, above).when(down, below).otherwise(0.0)).alias("held"))

    start = F.struct(F.col("peak").alias("low"), F.col("peak").alias("high"), at(F.col("peak")).alias("held"))
    areas = profile.withColumns({"total": total, "peak": peak}).where("total >= 1e-9").withColumn("area", F.aggregate(F.sequence(F.lit(1), F.lit(bins - 1)), start, grown)).select(*keys, "peak", "area")
    price = lambda i: F.col("bottom") + i * size + size / 2
    return day.join(areas, keys, "left").select(
        *keys,
        F.coalesce(price(F.col("peak")), (F.col("bottom") + F.col("top")) / 2).alias("poc"),
        F.coalesce(price(F.col("area.high")), F.col("top")).alias("vah"),
        F.coalesce(price(F.col("area.low")), F.col("bottom")).alias("val"),
    )


def _with_profiles(bars: DataFrame, p) -> DataFrame:
    """The finished day's profile stands at every bar of the day, so it looks ahead within the day."""
    days = session_profiles(bars).withColumnsRenamed({"session": "__session", "poc": "__t_poc", "vah": "__t_vah", "val": "__t_val"})
    return bars.withColumn("__session", F.to_date("datetime")).join(days, [*KEYS, "__session"], "left").drop("__session")


@indicator("Volume_Profile", "level", "feat_vp", channel("feat_vp", "VAL", "VAH", lambda h: h["POC"], 5, ((0.0, 1.0), (-1.0, 2.0)), ((0.0, 0.1), (0.0, 0.3)), ((-0.05, 0.05), (-0.15, 0.15))), _with_profiles)
def volume_profile(b, p):
    return {"POC": "__t_poc", "VAH": "__t_vah", "VAL": "__t_val"}


def _factor_columns(b: Columns, p) -> dict[str, str]:
    middle = b.let("(high + low) / 2e0")
    swing = b.let(f"{b.over('avg({})', middle, p.ao_fast)} - {b.over('avg({})', middle, p.ao_slow)}")
    flow = b.let("coalesce(((close - low) - (high - close)) / CASE WHEN high = low THEN 1e0 ELSE high - low END, 0e0) * volume")
    money = b.let(s.div(b.over("sum({})", flow, p.cmf_period), b.over("sum({})", "volume", p.cmf_period)))
    d = change(b, p.rsi_source)
    gain, loss = (b.smoothed(f"coalesce({x}, 0e0)", 2 / (p.rsi_period + 1)) for x in (f"greatest({d}, 0e0)", f"-least({d}, 0e0)"))
    strength = b.let(f"coalesce(100e0 - 100e0 / (1e0 + {s.div(gain, loss)}), 100e0)")
    return {f"__t_f{i}": b.forward(x) for i, x in enumerate((swing, money, strength))}


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _loadings(matrix: pd.Series) -> pd.Series:
    """Eigenvectors of small correlation matrices, the largest first; the largest loading of each is positive."""

    def of(flat):
        values, vectors = np.linalg.eigh(np.array(flat, dtype=float).reshape(3, 3))
        vectors = vectors[:, np.argsort(-values, kind="stable")]
        return [(v * np.sign(v[np.abs(v).argmax()])).tolist() for v in vectors.T]

    return matrix.map(of)


def with_factors(bars: DataFrame, p) -> DataFrame:
    """Adds __t_pc1, __t_pc2, __t_pc3: principal components of oscillator, money flow and strength, each scaled over the whole series.

    Only sums meet: nine numbers for each series. The fit sees the whole series, and so looks ahead. Rows in which a
    feature has no value yet, and series of fewer rows than components, have nulls.
    """
    names = [f"__t_f{i}" for i in range(3)]
    b = Columns()
    b.apart_from(bars.columns)
    df = b.add_to(bars, _factor_columns(b, p))
    whole = F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull() & F.col(names[2]).isNotNull()
    stats = df.where(whole).groupBy(*KEYS).agg(F.count("*").alias("__t_n"), *(F.avg(x).alias(f"__t_m{i}") for i, x in enumerate(names)), *(F.stddev_pop(x).alias(f"__t_s{i}") for i, x in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"__t_c{i}{j}") for i in range(3) for j in range(i, 3)))
    scale = lambda i: F.when(F.col(f"__t_s{i}") > 0, F.col(f"__t_s{i}")).otherwise(1.0)
    matrix = F.array(*[F.col(f"__t_c{min(i, j)}{max(i, j)}") / (scale(i) * scale(j)) for i in range(3) for j in range(3)])
    fits = stats.select(*KEYS, "__t_n", *(F.col(f"__t_m{i}") for i in range(3)), *(scale(i).alias(f"__t_s{i}") for i in range(3)), _loadings(matrix).alias("__t_load"))
    z = [(F.col(x) - F.col(f"__t_m{i}")) / F.col(f"__t_s{i}") for i, x in enumerate(names)]
    part = lambda k: F.when(whole & (F.col("__t_n") >= p.n_components), sum((z[i] * F.get(F.get("__t_load", k), i) for i in range(1, 3)), z[0] * F.get(F.get("__t_load", k), 0)))
    return df.join(fits, [*KEYS], "left").select(*bars.columns, *(part(k).alias(f"__t_pc{k + 1}") for k in range(3)))


def _factor_features(b, h, p):
    out = {}
    for i in range(1, p.n_components + 1):
        out |= around(f"feat_pca_pc{i}", lambda h, p, i=i: h[f"PC{i}"], ((-3.0, 3.0), (-5.0, 5.0)), ((-1.0, 1.0), (-3.0, 3.0)), ((0.0, 1.0), (0.0, 2.0)), 55, 5, 34)(b, h, p)
    return out


@indicator("PCA", "vector", "feat_pca", _factor_features, with_factors, n_components=2, ao_fast=5, ao_slow=34, cmf_period=20, rsi_period=14, rsi_source="close")
def pca(b, p):
    if not 1 <= p.n_components <= 3:
        raise ValueError("n_components must be 1, 2 or 3")
    return {f"PC{i}": f"__t_pc{i}" for i in range(1, p.n_components + 1)}
