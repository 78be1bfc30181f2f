"""Oscillators of price."""

from __future__ import annotations

from barloom.functions import sql as s
from barloom.functions.series import atr, change, chaikin, ema, highest, lowest, plain_zscore, rma, rsi, sma, stddev
from barloom.operators.indicators.registry import MOMENTUM, around, axis, indicator, relative, rough, standing

E = s.FEATURE_EPS
centred = lambda name: lambda h, p: f"({h[name]} - 50e0) / 50e0"
UNIT, TWO, HALF_LOG = ((-1.0, 1.0), (-1.2, 1.2)), ((-1.0, 1.0), (-2.0, 2.0)), ((0.0, 0.5), (0.0, 1.0))
HALF = ((-0.5, 0.5), (-1.0, 1.0))


def _ao_features(b, h, p):
    macro = p.get("adapt_macro_p", p.slow)
    bias = b.let(s.guarded(h["AO"], "close", E))
    return axis(b, "feat_ao_bias", bias, (-0.1, 0.1), (-0.5, 0.5)) | axis(b, "feat_ao_position", standing(b, h["AO"], macro), (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_ao_momentum", relative(b, bias, p.get("adapt_micro_p", p.fast)), *MOMENTUM) | axis(b, "feat_ao_volatility", rough(b, bias, p.get("adapt_vol_p", macro)), (0.0, 0.1), (0.0, 0.5))


@indicator("AO", "scalar", "feat_ao", _ao_features, fast=5, slow=34)
def ao(b, p):
    middle = b.let("(high + low) / 2e0")
    return {"AO": b.let(f"{sma(b, middle, p.fast)} - {sma(b, middle, p.slow)}")}


@indicator("RSI", "scalar", "feat_rsi", around("feat_rsi", centred("RSI"), UNIT, TWO, HALF_LOG, "period", 5, "period"), source="close", period=14)
def relative_strength_index(b, p):
    return {"RSI": rsi(b, p.source, p.period)}


@indicator("Refinement", "scalar", "feat_refinement", around("feat_refinement", centred("Refined"), UNIT, HALF, HALF_LOG, "rsi_period", 5, "refine_period"), rsi_source="close", rsi_period=14, refine_period=5)
def refinement(b, p):
    return {"Refined": ema(b, rsi(b, p.rsi_source, p.rsi_period), p.refine_period)}


@indicator("Relative_Strength", "scalar", "feat_rs", around("feat_rs", centred("RS"), UNIT, HALF, HALF_LOG, "period", 5, "period"), series_b="series_b", period=14)
def relative_strength(b, p):
    return {"RS": rsi(b, b.let(s.guarded("close", p.series_b)), p.period)}


def _macd(b, x, fast, slow, signal):
    line = b.let(f"{ema(b, x, fast)} - {ema(b, x, slow)}")
    smooth = ema(b, line, signal)
    return {"Line": line, "Signal": smooth, "Hist": b.let(f"{line} - {smooth}")}


def _macd_features(b, h, p):
    line, hist = b.let(s.guarded(h["Line"], "close", E)), b.let(s.guarded(h["Hist"], "close", E))
    return axis(b, "feat_macd_position", line, (-0.05, 0.05), (-0.2, 0.2)) | axis(b, "feat_macd_bias", hist, (-0.02, 0.02), (-0.1, 0.1)) | axis(b, "feat_macd_momentum", relative(b, hist, p.get("adapt_micro_p", p.signal_period)), *MOMENTUM) | axis(b, "feat_macd_volatility", rough(b, line, p.get("adapt_vol_p", p.slow_period)), (0.0, 0.1), (0.0, 0.3))


@indicator("MACD", "vector", "feat_macd", _macd_features, source="close", fast_period=12, slow_period=26, signal_period=9)
def macd(b, p):
    return _macd(b, p.source, p.fast_period, p.slow_period, p.signal_period)


def _n_macd_features(b, h, p):
    return axis(b, "feat_nmacd_position", h["Line"], (-1.0, 1.0), (-1.5, 1.5)) | axis(b, "feat_nmacd_bias", h["Hist"], *HALF) | axis(b, "feat_nmacd_momentum", relative(b, h["Hist"], p.get("adapt_micro_p", p.signal_period)), *MOMENTUM) | axis(b, "feat_nmacd_volatility", rough(b, h["Line"], p.get("adapt_vol_p", p.norm_period)), *HALF_LOG)


@indicator("N_MACD", "vector", "feat_nmacd", _n_macd_features, source="close", fast_period=12, slow_period=26, signal_period=9, norm_period=50)
def normalised_macd(b, p):
    fast, slow = ema(b, p.source, p.fast_period), ema(b, p.source, p.slow_period)
    ratio = b.let(s.guarded(s.smallest(fast, slow), s.largest(fast, slow)))
    raw = b.let(f"CASE WHEN {fast} > {slow} THEN 2e0 - {ratio} ELSE {ratio} END - 1e0")
    low, high = lowest(b, raw, p.norm_period), highest(b, raw, p.norm_period)
    line = b.let(f"{s.guarded(f'{raw} - {low}', f'{high} - {low}')} * 2e0 - 1e0")
    signal = rma(b, line, p.signal_period)
    return {"Line": line, "Signal": signal, "Hist": b.let(f"{line} - {signal}")}


def _obv_macd_features(b, h, p):
    macro = p.get("adapt_macro_p", p.slow_period)
    wide = b.over("stddev_samp({})", h["Line"], macro, 2)
    line, hist = b.let(standing(b, h["Line"], macro)), b.let(s.guarded(h["Hist"], wide, E))
    return axis(b, "feat_obv_macd_position", line, (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_obv_macd_bias", hist, (-1.0, 1.0), (-3.0, 3.0)) | axis(b, "feat_obv_macd_momentum", relative(b, hist, p.get("adapt_micro_p", p.signal_period)), *MOMENTUM) | axis(b, "feat_obv_macd_volatility", rough(b, line, p.get("adapt_vol_p", p.slow_period)), (0.0, 1.0), (0.0, 2.0))


@indicator("Rolling_OBV_MACD", "vector", "feat_obv_macd", _obv_macd_features, obv_period=20, fast_period=12, slow_period=26, signal_period=9)
def rolling_obv_macd(b, p):
    from barloom.functions.series import on_balance

    total = on_balance(b)
    return _macd(b, b.let(f"{total} - {b.lag(total, p.obv_period)}"), p.fast_period, p.slow_period, p.signal_period)


def _stochastic_features(b, h, p):
    k, d = b.let(f"({h['K']} - 50e0) / 50e0"), b.let(f"({h['D']} - 50e0) / 50e0")
    return axis(b, "feat_stoch_position", k, *UNIT) | axis(b, "feat_stoch_bias", f"{k} - {d}", *HALF) | axis(b, "feat_stoch_momentum", relative(b, k, p.get("adapt_micro_p", p.d_period)), *MOMENTUM) | axis(b, "feat_stoch_volatility", rough(b, k, p.get("adapt_vol_p", p.k_period)), *HALF_LOG)


@indicator("Stochastic", "vector", "feat_stoch", _stochastic_features, source="close", k_period=14, d_period=3, smooth_k_period=3)
def stochastic(b, p):
    low, high = lowest(b, "low", p.k_period), highest(b, "high", p.k_period)
    k = sma(b, f"100e0 * {s.guarded(f'{p.source} - {low}', f'{high} - {low}')}", p.smooth_k_period)
    return {"K": k, "D": sma(b, k, p.d_period)}


@indicator("Schaff_Trend_Cycle", "scalar", "feat_stc", around("feat_stc", centred("STC"), UNIT, TWO, HALF_LOG, "cycle", "d1", "cycle"), source="close", fast=23, slow=50, cycle=10, d1=3)
def schaff(b, p):
    def stochastic_of(x):
        low, high = lowest(b, x, p.cycle), highest(b, x, p.cycle)
        place = b.let(s.case((f"{high} > {low}", f"100e0 * {s.guarded(f'{x} - {low}', f'{high} - {low}')}")))
        return b.let(s.fill(b.forward(place), "50e0"))

    line = b.let(f"{ema(b, p.source, p.fast)} - {ema(b, p.source, p.slow)}")
    return {"STC": ema(b, stochastic_of(ema(b, stochastic_of(line), p.d1)), p.d1)}


def _tsi_features(b, h, p):
    line, signal = b.let(f"{h['TSI']} / 100e0"), b.let(f"{h['Signal']} / 100e0")
    return axis(b, "feat_tsi_position", line, *UNIT) | axis(b, "feat_tsi_bias", f"{line} - {signal}", *HALF) | axis(b, "feat_tsi_momentum", relative(b, line, p.get("adapt_micro_p", p.signal)), *MOMENTUM) | axis(b, "feat_tsi_volatility", rough(b, line, p.get("adapt_vol_p", p.short)), *HALF_LOG)


@indicator("TSI", "vector", "feat_tsi", _tsi_features, source="close", long=25, short=13, signal=7)
def true_strength(b, p):
    d = change(b, p.source)
    top = ema(b, ema(b, d, p.long), p.short)
    bottom = ema(b, ema(b, f"abs({d})", p.long), p.short)
    line = b.let(f"100e0 * {s.guarded(top, bottom)}")
    return {"TSI": line, "Signal": ema(b, line, p.signal)}


def _qqe_features(b, h, p):
    bias = b.let(s.guarded(f"{h['SmoothedRSI']} - 50e0", f"{h['Long']} - {h['Short']}", E))
    return axis(b, "feat_qqe_position", standing(b, h["SmoothedRSI"], p.get("adapt_macro_p", p.rsi_period)), (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_qqe_bias", bias, *TWO) | axis(b, "feat_qqe_momentum", relative(b, bias, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_qqe_volatility", rough(b, bias, p.get("adapt_vol_p", p.smoothing)), *HALF_LOG)


@indicator("QQE_Mod", "vector", "feat_qqe", _qqe_features, rsi_source="close", rsi_period=14, smoothing=5, q=4.236)
def qqe(b, p):
    smooth = ema(b, rsi(b, p.rsi_source, p.rsi_period), p.smoothing)
    reach = ema(b, rma(b, f"abs({change(b, smooth)})", p.smoothing), 2 * p.smoothing - 1)
    return {"Long": b.let(f"{smooth} + {reach} * {s.num(p.q)}"), "Short": b.let(f"{smooth} - {reach} * {s.num(p.q)}"), "SmoothedRSI": smooth}


@indicator("TDFI", "scalar", "feat_tdfi", around("feat_tdfi", lambda h, p: f"{h['TDFI']} / 50e0", TWO, TWO, HALF_LOG, "smma_length", 5, "std_length"), price_src="close", mma_length=5, smma_length=13, std_length=13, multiplier=2.0)
def trend_direction_force(b, p):
    fast = ema(b, p.price_src, p.mma_length)
    slow = ema(b, fast, p.smma_length)
    wide = f"{s.num(p.multiplier)} * {stddev(b, slow, p.std_length)}"
    low, high = b.let(f"{slow} - {wide}"), b.let(f"{slow} + {wide}")
    place = f"CASE WHEN {high} <> {low} THEN {s.guarded(f'{fast} - {low}', f'{high} - {low}')} ELSE 5e-1 END"
    return {"TDFI": b.let(f"({place} - 5e-1) * 100e0")}


def _fusion_features(b, h, p):
    x = h["Factor1"]
    return axis(b, "feat_fusion_position", x, (-3.0, 3.0), (-6.0, 6.0)) | axis(b, "feat_fusion_bias", f"{x} - {h['Factor2']}", (-1.0, 1.0), (-3.0, 3.0)) | axis(b, "feat_fusion_momentum", relative(b, x, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_fusion_volatility", rough(b, x, p.get("adapt_vol_p", p.z_window)), (0.0, 1.0), (0.0, 2.0))


@indicator("Fusion", "vector", "feat_fusion", _fusion_features, rsi_source="close", rsi_period=14, cmf_period=20, ao_fast=5, ao_slow=34, z_window=50, signal_period=9)
def fusion(b, p):
    parts = [ao(b, type(p)(fast=p.ao_fast, slow=p.ao_slow))["AO"], rsi(b, p.rsi_source, p.rsi_period), chaikin(b, p.cmf_period)]
    factor = b.let(f"({' + '.join(plain_zscore(b, x, p.z_window) for x in parts)}) / 3e0")
    return {"Factor1": factor, "Factor2": ema(b, factor, p.signal_period)}


@indicator("Efficiency", "scalar", "feat_er", around("feat_er", lambda h, p: h["ER"], ((0.0, 1.0), (-0.1, 1.1)), ((-0.2, 0.2), (-0.8, 0.8)), ((0.0, 0.2), (0.0, 0.5)), 21, 5, 34), source="close", period=10)
def efficiency(b, p):
    from barloom.functions.series import rolling_sum

    steps = rolling_sum(b, f"abs({change(b, p.source)})", p.period)
    return {"ER": b.let(s.guarded(f"abs({p.source} - {b.lag(p.source, p.period)})", steps))}


def _wae_features(b, h, p):
    trend = b.let(s.guarded(h["NetTrend"], "close", E))
    return axis(b, "feat_wae_position", trend, (-0.1, 0.1), (-0.5, 0.5)) | axis(b, "feat_wae_bias", s.guarded(f"{h['Explosion']} - {h['DeadZone']}", h["DeadZone"], E), (-1.0, 2.0), (-1.0, 5.0)) | axis(b, "feat_wae_momentum", relative(b, trend, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_wae_volatility", rough(b, trend, p.get("adapt_vol_p", 34)), *HALF_LOG)


@indicator("WAE", "vector", "feat_wae", _wae_features, sensitivity=150.0, fast=20, slow=40, channel=20, mult=2.0, dz_p=100, dz_m=3.7)
def waddah(b, p):
    line = b.let(f"{ema(b, 'close', p.fast)} - {ema(b, 'close', p.slow)}")
    push = b.let(f"{change(b, line)} * {s.num(p.sensitivity)}")
    up, down = b.let(f"greatest({push}, 0e0)"), b.let(f"greatest(-({push}), 0e0)")
    return {"TrendUp": up, "TrendDown": down, "NetTrend": push, "Explosion": b.let(f"2e0 * {s.num(p.mult)} * {stddev(b, 'close', p.channel)}"), "DeadZone": b.let(f"{atr(b, p.dz_p)} * {s.num(p.dz_m)}")}
