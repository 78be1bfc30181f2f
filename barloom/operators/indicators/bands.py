"""Volatility, channels and stops."""

from __future__ import annotations

from barloom.functions import sql as s
from barloom.functions.recurrences import Flipping, Trailing
from barloom.functions.series import atr, directional, ema, highest, lowest, sma, stddev, zscore
from barloom.operators.indicators.registry import MOMENTUM, around, axis, channel, from_mean, indicator, relative, rough, standing

E = s.FEATURE_EPS
PERCENT, TENTH = ((0.0, 1.0), (-1.0, 2.0)), ((-0.1, 0.1), (-0.3, 0.3))
HALF_LOG, FIFTH = ((0.0, 0.5), (0.0, 1.0)), ((0.0, 0.2), (0.0, 0.5))
between = lambda low, high: lambda h: f"({h[low]} + {h[high]}) / 2e0"


def _atr_features(b, h, p):
    x = b.let(s.guarded(h["ATR"], "close", E))
    macro = p.get("adapt_macro_p", p.Len)
    return axis(b, "feat_atr_norm", s.log1p(x), (0.0, 0.1), (0.0, 0.5)) | axis(b, "feat_atr_position", standing(b, x, macro), (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_atr_bias", f"{s.guarded(x, b.over('avg({})', x, macro), E)} - 1e0", (-0.5, 1.0), (-0.8, 3.0)) | axis(b, "feat_atr_momentum", relative(b, x, p.get("adapt_micro_p", p.Len)), *MOMENTUM)


@indicator("ATR", "scalar", "feat_atr", _atr_features, Len=14)
def average_true_range(b, p):
    return {"ATR": atr(b, p.Len)}


@indicator("ATR_Stops", "level", "feat_atr_stops", channel("feat_atr_stops", "Long", "Short", between("Long", "Short"), "atr_len", PERCENT, FIFTH, TENTH, per=lambda h: "close"), atr_len=14, multiplier=2.0)
def atr_stops(b, p):
    reach = f"{atr(b, p.atr_len)} * {s.num(p.multiplier)}"
    return {"Long": b.let(f"high - {reach}"), "Short": b.let(f"low + {reach}")}


@indicator("Chandelier_Exit", "level", "feat_chandelier", channel("feat_chandelier", "LongStop", "ShortStop", between("LongStop", "ShortStop"), "atr_len", PERCENT, FIFTH, TENTH, per=lambda h: "close"), atr_len=22, multiplier=3.0)
def chandelier(b, p):
    reach = f"{atr(b, p.atr_len)} * {s.num(p.multiplier)}"
    long, short = b.scan(Trailing, ["close", f"{highest(b, 'high', p.atr_len)} - {reach}", f"{lowest(b, 'low', p.atr_len)} + {reach}"])
    return {"LongStop": long, "ShortStop": short}


def _avo_features(b, h, p):
    x = h["ZScore"]
    return axis(b, "feat_avo_position", x, (-3.0, 3.0), (-6.0, 6.0)) | axis(b, "feat_avo_bias", f"{x} - {b.over('avg({})', x, p.get('adapt_macro_p', p.analysis_period))}", (-1.0, 1.0), (-3.0, 3.0)) | axis(b, "feat_avo_momentum", relative(b, x, p.get("adapt_micro_p", p.atr_len)), *MOMENTUM) | axis(b, "feat_avo_volatility", rough(b, x, p.get("adapt_vol_p", p.analysis_period)), (0.0, 1.0), (0.0, 3.0))


@indicator("AVO", "scalar", "feat_avo", _avo_features, atr_len=14, analysis_period=50)
def volatility_score(b, p):
    return {"ZScore": zscore(b, atr(b, p.atr_len), p.analysis_period)}


@indicator("Bollinger_Bands", "vector", "feat_bb", channel("feat_bb", "Lower", "Upper", lambda h: h["Middle"], "period", PERCENT, ((0.0, 3.0), (0.0, 10.0)), ((-0.5, 0.5), (-3.0, 3.0))), source="close", period=20, std=2.0)
def bollinger(b, p):
    middle, wide = sma(b, p.source, p.period), f"{s.num(p.std)} * {stddev(b, p.source, p.period)}"
    return {"Upper": b.let(f"{middle} + {wide}"), "Middle": middle, "Lower": b.let(f"{middle} - {wide}")}


@indicator("Donchian", "vector", "feat_donchian", channel("feat_donchian", "Lower", "Upper", lambda h: h["Middle"], "period", ((0.0, 1.0), (-0.1, 1.1)), ((0.0, 0.3), (0.0, 1.0)), ((-0.15, 0.15), (-0.5, 0.5))), period=20)
def donchian(b, p):
    high, low = highest(b, "high", p.period), lowest(b, "low", p.period)
    return {"Upper": high, "Middle": b.let(f"({high} + {low}) / 2e0"), "Lower": low}


@indicator("Keltner_Channels", "vector", "feat_keltner", channel("feat_keltner", "Lower", "Upper", lambda h: h["Middle"], "ema_period", PERCENT, FIFTH, TENTH), ema_period=20, atr_len=10, multiplier=2.0)
def keltner(b, p):
    middle, wide = ema(b, "close", p.ema_period), f"{atr(b, p.atr_len)} * {s.num(p.multiplier)}"
    return {"Upper": b.let(f"{middle} + {wide}"), "Middle": middle, "Lower": b.let(f"{middle} - {wide}")}


def _pressure_features(b, h, p):
    apart = b.let(s.guarded(f"{h['BBW']} - {h['KCW']}", h["KCW"], E))
    return axis(b, "feat_pressure_position", b.ewm(h["Squeeze"], p.get("adapt_macro_p", p.bb_period)), (0.0, 1.0)) | axis(b, "feat_pressure_bias", apart, (-0.5, 0.5), (-1.0, 2.0)) | axis(b, "feat_pressure_momentum", relative(b, apart, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_pressure_volatility", b.over("stddev_samp({})", h["Squeeze"], p.get("adapt_vol_p", p.kc_period), 2), (0.0, 0.5))


@indicator("Pressure", "vector", "feat_pressure", _pressure_features, bb_period=20, bb_std=2.0, kc_period=20, atr_period=14)
def pressure(b, p):
    p.positive("bb_period", "bb_std", "kc_period", "atr_period")
    middle, wide = sma(b, "close", p.bb_period), f"{s.num(p.bb_std)} * {stddev(b, 'close', p.bb_period)}"
    upper, lower = b.let(f"{middle} + {wide}"), b.let(f"{middle} - {wide}")
    typical = ema(b, "(high + low + close) / 3e0", p.kc_period)
    reach = f"15e-1 * {atr(b, p.atr_period)}"
    above, below = b.let(f"{typical} + {reach}"), b.let(f"{typical} - {reach}")
    inside = s.case((f"{upper} < {above} AND {lower} > {below}", "1e0"), otherwise="0e0")
    return {"Squeeze": b.let(inside), "BBW": b.let(s.guarded(f"{upper} - {lower}", middle)), "KCW": b.let(s.guarded(f"{above} - {below}", typical))}


def _supertrend_features(b, h, p):
    bias = b.let(s.guarded(f"close - {h['Trend']}", h["Trend"], E))
    return axis(b, "feat_supertrend_position", b.ewm(h["Direction"], p.get("adapt_macro_p", 55)), (-0.8, 0.8), (-1.0, 1.0)) | axis(b, "feat_supertrend_bias", bias, (-0.1, 0.1), (-0.3, 0.3)) | axis(b, "feat_supertrend_momentum", relative(b, bias, p.get("adapt_micro_p", p.atr_len)), *MOMENTUM) | axis(b, "feat_supertrend_volatility", rough(b, h["Direction"], p.get("adapt_vol_p", 34)), *HALF_LOG)


@indicator("SuperTrend", "vector", "feat_supertrend", _supertrend_features, atr_len=14, multiplier=3.0)
def supertrend(b, p):
    middle, reach = "(high + low) / 2e0", f"{atr(b, p.atr_len)} * {s.num(p.multiplier)}"
    trend, direction = b.scan(Flipping, ["close", f"{middle} - {reach}", f"{middle} + {reach}"])
    return {"Trend": trend, "Direction": direction}


@indicator("Volatility_Geometry", "scalar", "feat_vol_geo", around("feat_vol_geo", lambda h, p: s.guarded(h["Geometry"], "close", E), ((-0.05, 0.05), (-0.2, 0.2)), ((-0.05, 0.05), (-0.15, 0.15)), FIFTH, "atr_period", 5, "period"), period=5, atr_period=14)
def volatility_geometry(b, p):
    x = atr(b, p.atr_period)
    return {"Geometry": b.let(f"{x} - {b.lag(x, p.period)}")}


@indicator("Volatility_Skew", "scalar", "feat_skew", around("feat_skew", lambda h, p: f"({h['Skew']} - 5e-1) * 2e0", ((-1.0, 1.0), (-1.5, 1.5)), ((-1.0, 1.0), (-2.0, 2.0)), HALF_LOG, "window", 5, "vol_period"), price="close", vol_period=14, window=20)
def volatility_skew(b, p):
    reach = atr(b, p.vol_period)
    low, high = b.let(f"{lowest(b, p.price, p.window)} + {reach}"), b.let(f"{highest(b, p.price, p.window)} - {reach}")
    return {"Skew": b.let(s.guarded(f"{p.price} - {low}", f"{high} - {low}"))}


def _vwap_features(b, h, p):
    apart = b.let(s.guarded(f"close - {h['VWAP']}", h["StdDev"], E))
    return axis(b, "feat_vwap_position", apart, (-3.0, 3.0), (-6.0, 6.0)) | axis(b, "feat_vwap_bias", f"{s.guarded('close', h['VWAP'], E)} - 1e0", (-0.05, 0.05), (-0.2, 0.2)) | axis(b, "feat_vwap_momentum", relative(b, apart, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_vwap_volatility", s.log1p(s.guarded(h["StdDev"], h["VWAP"], E)), (0.0, 0.05), (0.0, 0.2))


@indicator("VWAP", "level", "feat_vwap", _vwap_features, stds=(1.0, 1.5, 2.0))
def vwap(b, p):
    session = s.frame(None, partition="PARTITION BY symbol, timeframe, CAST(datetime AS DATE) ORDER BY datetime")
    price = b.let("(high + low + close) / 3e0")
    total = lambda x: b.let(f"sum(coalesce({b.let(x)}, 0e0)) {session}")
    volume = total("volume")
    mean = b.let(s.fill(s.guarded(total(f"{price} * volume"), volume)))
    square = b.let(s.fill(s.guarded(total(f"{s.bounded_pow(price, 2)} * volume"), volume)))
    wide = b.let(s.safe_sqrt(f"{square} - {s.bounded_pow(mean, 2)}"))
    bands = {f"{side}{i}": b.let(f"{mean} {sign} {s.num(k)} * {wide}") for i, k in enumerate(p.stds, 1) for side, sign in (("Upper", "+"), ("Lower", "-"))}
    return {"VWAP": mean, "StdDev": wide} | bands


def _state_score_features(b, h, p):
    score = b.let(s.case(*((f"{h['State']} = {k}", v) for k, v in ((1, "1e0"), (2, "5e-1"), (3, "-5e-1"), (4, "-1e0"))), otherwise="0e0"))
    macro = p.get("adapt_macro_p", p.adx_len)
    return axis(b, "feat_ms_position", b.ewm(score, macro), (-0.8, 0.8), (-1.0, 1.0)) | axis(b, "feat_ms_bias", from_mean(b, score, macro), (-1.0, 1.0), (-2.0, 2.0)) | axis(b, "feat_ms_momentum", relative(b, score, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_ms_volatility", rough(b, score, p.get("adapt_vol_p", p.bb_period)), *HALF_LOG)


@indicator("Market_State", "event", "feat_ms", _state_score_features, di_len=14, adx_len=14, bb_period=20, bb_std=2.0, trend_thresh=25.0, vol_thresh_pct=0.1)
def market_state(b, p):
    """1: trend and wide bands, 2: trend and narrow ones, 3: neither, 4: wide bands without trend."""
    p.positive("di_len", "adx_len", "bb_period", "bb_std", "trend_thresh", "vol_thresh_pct")
    strength = directional(b, p.di_len, p.adx_len)[2]
    middle = sma(b, "close", p.bb_period)
    width = s.guarded(f"2e0 * {s.num(p.bb_std)} * {stddev(b, 'close', p.bb_period)}", middle)
    trend, wide = f"{strength} > {s.num(p.trend_thresh)}", f"{width} > {s.num(p.vol_thresh_pct)}"
    return {"State": b.let(s.case((f"{trend} AND {wide}", "1"), (trend, "2"), (wide, "4"), otherwise="3"))}
