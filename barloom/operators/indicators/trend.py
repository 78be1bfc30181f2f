"""Moving averages and what is read from their order."""

from __future__ import annotations

import math

from barloom.functions import sql as s
from barloom.functions.recurrences import Kalman
from barloom.functions.series import atr, directional, ema, highest, lowest, rma, rolling_sum, true_range
from barloom.operators.indicators.registry import MOMENTUM, around, axis, from_mean, indicator, relative, rough, standing

E = s.FEATURE_EPS
HALF_LOG, WIDE = ((0.0, 0.5), (0.0, 1.0)), ((-0.8, 0.8), (-1.0, 1.0))


def _dmi_features(b, h, p):
    lead = b.let(s.guarded(f"{h['PlusDI']} - {h['MinusDI']}", f"{h['PlusDI']} + {h['MinusDI']}", E))
    return axis(b, "feat_dmi_position", lead, *WIDE) | axis(b, "feat_dmi_volatility", f"{h['ADX']} / 100e0", (0.0, 0.6), (0.0, 1.0)) | axis(b, "feat_dmi_bias", f"({from_mean(b, h['ADX'], p.get('adapt_macro_p', p.adx_len))}) / 100e0", (-0.2, 0.2), (-0.5, 0.5)) | axis(b, "feat_dmi_momentum", relative(b, lead, p.get("adapt_micro_p", p.di_len)), *MOMENTUM)


@indicator("DMI_ADX", "vector", "feat_dmi", _dmi_features, di_len=14, adx_len=14)
def dmi(b, p):
    plus, minus, strength = directional(b, p.di_len, p.adx_len)
    return {"PlusDI": plus, "MinusDI": minus, "ADX": strength}


def _donchian_trend_features(b, h, p):
    t = h["Trend"]
    return axis(b, "feat_donchian_trend_position", t, (-1.0, 1.0)) | axis(b, "feat_donchian_trend_bias", b.ewm(t, p.get("adapt_macro_p", 21)), *WIDE) | axis(b, "feat_donchian_trend_momentum", f"({t} - {b.lag(t)}) / 2e0", (-1.0, 1.0), (-2.0, 2.0)) | axis(b, "feat_donchian_trend_volatility", rough(b, t, p.get("adapt_vol_p", 34)), (0.0, 0.4), (0.0, 1.0))


@indicator("Donchian_Trend", "event", "feat_donchian_trend", _donchian_trend_features, period=20)
def donchian_trend(b, p):
    """The side on which the close last left the channel of the rows before."""
    up, down = b.let(s.fill(b.lag(highest(b, "high", p.period)))), b.let(s.fill(b.lag(lowest(b, "low", p.period))))
    left = s.case((f"close > {up} AND {up} <> 0", "1e0"), (f"close < {down} AND {down} <> 0", "-1e0"))
    return {"Trend": b.let(s.fill(b.forward(left)))}


def _cluster_features(b, h, p):
    lines = [h[f"EMA_{n}"] for n in (8, 13, 21, 55)]
    top, bottom, centre = b.let(s.largest(*lines)), b.let(s.smallest(*lines)), b.let(f"({' + '.join(lines)}) / 4e0")
    place = b.let(s.guarded(f"close - {bottom}", f"{top} - {bottom}", E))
    return axis(b, "feat_ema_cluster_position", place, (-0.5, 1.5), (-3.0, 4.0), empty=0.5) | axis(b, "feat_ema_cluster_volatility", s.log1p(s.guarded(f"{top} - {bottom}", centre, E)), (0.0, 0.2), (0.0, 0.6)) | axis(b, "feat_ema_cluster_bias", f"{s.guarded('close', centre, E)} - 1e0", (-0.2, 0.2), (-0.8, 0.8)) | axis(b, "feat_ema_cluster_momentum", relative(b, place, p.get("adapt_micro_p", p.len1)), *MOMENTUM)


@indicator("EMA_Cluster", "vector", "feat_ema_cluster", _cluster_features, source="close", len1=8, len2=13, len3=21, len4=55)
def ema_cluster(b, p):
    """The names are fixed, whatever the lengths."""
    return {f"EMA_{name}": ema(b, p.source, n) for name, n in zip((8, 13, 21, 55), (p.len1, p.len2, p.len3, p.len4), strict=True)}


def _geography_features(b, h, p):
    x = h["State"]
    fast, slow = h["FastLine"], h["SlowLine"]
    return axis(b, "feat_geography_position", b.ewm(x, p.get("adapt_macro_p", 21)), *WIDE) | axis(b, "feat_geography_volatility", s.log1p(s.guarded(f"abs({fast} - {slow})", slow, E)), (0.0, 0.2), (0.0, 0.5)) | axis(b, "feat_geography_bias", f"{s.guarded('close', f'({fast} + {slow}) / 2e0', E)} - 1e0", (-0.15, 0.15), (-0.5, 0.5)) | axis(b, "feat_geography_momentum", relative(b, x, p.get("adapt_micro_p", 9)), *MOMENTUM)


@indicator("Geography", "event", "feat_geography", _geography_features, fast_period=20, slow_period=50)
def geography(b, p):
    fast, slow = ema(b, "close", p.fast_period), ema(b, "close", p.slow_period)
    return {"State": b.let(s.case((f"close > {fast}", "1e0"), (f"close < {slow}", "-1e0"), otherwise="0e0")), "FastLine": fast, "SlowLine": slow}


def _heikin_features(b, h, p):
    purity = b.let(s.guarded(f"{h['HA_Close']} - {h['HA_Open']}", f"{h['HA_High']} - {h['HA_Low']}", E))
    return axis(b, "feat_ha_position", purity, (-1.0, 1.0)) | axis(b, "feat_ha_bias", f"{s.guarded('close', h['HA_Close'], E)} - 1e0", (-0.05, 0.05), (-0.2, 0.2)) | axis(b, "feat_ha_momentum", relative(b, purity, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_ha_volatility", rough(b, purity, p.get("adapt_vol_p", 21)), *HALF_LOG)


@indicator("Heikin_Ashi", "vector", "feat_ha", _heikin_features)
def heikin_ashi(b, p):
    """Each open is halfway between the open and the close before: an average of the closes before with weight one half."""
    middle = b.let("(open + high + low + close) / 4e0")
    start = b.smoothed(f"coalesce({b.lag(middle)}, (open + close) / 2e0)", 0.5)
    return {"HA_Open": start, "HA_High": b.let(f"greatest(high, {start}, {middle})"), "HA_Low": b.let(f"least(low, {start}, {middle})"), "HA_Close": middle}


def _hull_features(b, h, p):
    bias = b.let(f"{s.guarded('close', h['HMA'], E)} - 1e0")
    return axis(b, "feat_hma_position", standing(b, h["HMA"], p.get("adapt_macro_p", 55)), (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_hma_bias", bias, (-0.1, 0.1), (-0.3, 0.3)) | axis(b, "feat_hma_momentum", relative(b, bias, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_hma_volatility", rough(b, bias, p.get("adapt_vol_p", p.length)), (0.0, 0.1), (0.0, 0.3))


@indicator("Hull_MA", "vector", "feat_hma", _hull_features, source="close", length=21)
def hull(b, p):
    half, whole = rma(b, p.source, p.length // 2), rma(b, p.source, p.length)
    return {"HMA": rma(b, f"2e0 * {half} - {whole}", math.isqrt(p.length))}


def _kalman_features(b, h, p):
    x, n = h["Filtered"], p.get("adapt_macro_p", 55)
    mean, wide = b.over("avg({})", x, n), b.over("stddev_samp({})", x, n, 2)
    return axis(b, "feat_kalman_position", standing(b, x, n), (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_kalman_bias", s.guarded(f"{x} - {mean}", f"abs({mean})", E), (-0.2, 0.2), (-0.5, 0.5)) | axis(b, "feat_kalman_momentum", relative(b, x, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_kalman_volatility", s.log1p(s.guarded(wide, f"abs({mean})", E)), (0.0, 0.2), (0.0, 0.5))


@indicator("Kalman_Filter", "scalar", "feat_kalman", _kalman_features, input_feature="close", process_noise=0.001, measurement_noise=0.1)
def kalman(b, p):
    return {"Filtered": b.scan(Kalman, [b.forward(p.input_feature)], float(p.process_noise), float(p.measurement_noise))[0]}


def _narrative_features(b, h, p):
    fast, slow, state = h["TrendFast"], h["TrendSlow"], h["MarketState"]
    return axis(b, "feat_narrative_position", s.guarded(f"{fast} - {slow}", slow, E), (-0.2, 0.2), (-0.5, 0.5)) | axis(b, "feat_narrative_bias", b.ewm(state, p.get("adapt_macro_p", p.th_slow_p)), (0.0, 1.0)) | axis(b, "feat_narrative_momentum", s.guarded(h["VolGeo"], "close", E), (-0.05, 0.05), (-0.15, 0.15)) | axis(b, "feat_narrative_volatility", b.over("stddev_samp({})", state, p.get("adapt_vol_p", p.ms_adx_len), 2), (0.0, 0.5))


@indicator("Narrative", "vector", "feat_narrative", _narrative_features, th_fast_p=13, th_mid_p=34, th_slow_p=89, ms_di_len=14, ms_adx_len=14, vg_atr_p=14, vg_diff_p=5)
def narrative(b, p):
    fast, middle, slow = (ema(b, "close", n) for n in (p.th_fast_p, p.th_mid_p, p.th_slow_p))
    strength = directional(b, p.ms_di_len, p.ms_adx_len)[2]
    x = atr(b, p.vg_atr_p)
    return {"TrendFast": fast, "TrendMid": middle, "TrendSlow": slow, "MarketState": b.let(s.case((f"{strength} > 25e0", "1e0"), otherwise="0e0")), "VolGeo": b.let(f"{x} - {b.lag(x, p.vg_diff_p)}")}


def _health_features(b, h, p):
    x, apart = h["Alignment"], b.let(s.guarded(h["Dispersion"], "close", E))
    macro = p.get("adapt_macro_p", p.slow_period)
    return axis(b, "feat_th_position", b.ewm(x, macro), *WIDE) | axis(b, "feat_th_bias", from_mean(b, x, macro), (-1.0, 1.0), (-2.0, 2.0)) | axis(b, "feat_th_momentum", relative(b, apart, p.get("adapt_micro_p", p.fast_period)), *MOMENTUM) | axis(b, "feat_th_volatility", rough(b, x, p.get("adapt_vol_p", p.mid_period)), *HALF_LOG)


@indicator("Trend_Health", "vector", "feat_th", _health_features, fast_period=13, mid_period=34, slow_period=89)
def trend_health(b, p):
    fast, middle, slow = (ema(b, "close", n) for n in (p.fast_period, p.mid_period, p.slow_period))
    apart = b.let(f"abs({fast} - {slow})")
    aligned = s.case((f"{fast} > {middle} AND {middle} > {slow}", "1e0"), (f"{fast} < {middle} AND {middle} < {slow}", "-1e0"), otherwise="0e0")
    return {"Direction": b.let(s.case((f"{fast} > {slow}", "1e0"), (f"{fast} < {slow}", "-1e0"), otherwise="0e0")), "Alignment": b.let(aligned), "Dispersion": b.let(f"{apart} - {b.lag(apart)}")}


@indicator("Vortex", "vector", "feat_vortex", around("feat_vortex", lambda h, p: f"{h['VIP']} - {h['VIM']}", ((-1.0, 1.0), (-1.5, 1.5)), ((-0.5, 0.5), (-1.0, 1.0)), HALF_LOG, "period", 5, "period"), period=14)
def vortex(b, p):
    total = rolling_sum(b, true_range(b), p.period)
    side = lambda a, c: b.let(s.guarded(rolling_sum(b, f"abs({a} - {b.lag(c)})", p.period), total))
    return {"VIP": side("high", "low"), "VIM": side("low", "high")}
