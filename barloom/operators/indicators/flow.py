"""Volume and money flow."""

from __future__ import annotations

from barloom.functions import sql as s
from barloom.functions.series import chaikin, change, ema, on_balance, sma
from barloom.operators.indicators.registry import MOMENTUM, around, axis, from_mean, indicator, relative, rough, standing

E = s.FEATURE_EPS
HALF_LOG, THREE = ((0.0, 0.5), (0.0, 1.0)), ((-3.0, 3.0), (-5.0, 5.0))


@indicator("CMF", "scalar", "feat_cmf", around("feat_cmf", lambda h, p: h["value"], ((-0.5, 0.5), (-1.0, 1.0)), ((-0.2, 0.2), (-0.8, 0.8)), ((0.0, 0.2), (0.0, 0.5)), "period", "period", "period"), period=20)
def cmf(b, p):
    return {"value": chaikin(b, p.period)}


def _obv_features(b, h, p):
    macro = p.get("adapt_macro_p", 55)
    x = b.let(standing(b, h["OBV"], macro))
    bias = b.let(from_mean(b, x, macro))
    return axis(b, "feat_obv_position", x, *THREE) | axis(b, "feat_obv_bias", bias, (-1.0, 1.0), (-3.0, 3.0)) | axis(b, "feat_obv_momentum", relative(b, bias, p.get("adapt_micro_p", 13)), *MOMENTUM) | axis(b, "feat_obv_volatility", rough(b, x, p.get("adapt_vol_p", 34)), *HALF_LOG)


@indicator("OBV", "scalar", "feat_obv", _obv_features)
def obv(b, p):
    return {"OBV": on_balance(b)}


@indicator("Flow_Context", "vector", "feat_flow_context", around("feat_flow_context", lambda h, p: s.guarded(h["Acceleration"], h["BaseVolEMA"], E), ((-2.0, 2.0), (-5.0, 5.0)), ((-1.0, 1.0), (-3.0, 3.0)), ((0.0, 1.0), (0.0, 3.0)), "inertia_p", "momentum_p", "inertia_p"), inertia_p=34, momentum_p=8)
def flow_context(b, p):
    p.positive("inertia_p", "momentum_p")
    if p.momentum_p >= p.inertia_p:
        raise ValueError("momentum_p must be less than inertia_p")
    total = on_balance(b)
    slow, fast = ema(b, total, p.inertia_p), ema(b, total, p.momentum_p)
    return {"Inertia": slow, "Momentum": fast, "Acceleration": b.let(f"{fast} - {slow}"), "BaseVolEMA": ema(b, "volume", p.inertia_p)}


def _force_features(b, h, p):
    macro = p.get("adapt_macro_p", 34)
    x = b.let(s.guarded(h["RawForce"], f"{ema(b, 'close', macro)} * {ema(b, 'volume', macro)}", E))
    return axis(b, "feat_force_context_position", x, (-1.0, 1.0), (-3.0, 3.0)) | axis(b, "feat_force_context_bias", from_mean(b, x, macro), (-0.5, 0.5), (-1.5, 1.5)) | axis(b, "feat_force_context_momentum", relative(b, x, p.get("adapt_micro_p", 9)), *MOMENTUM) | axis(b, "feat_force_context_volatility", rough(b, x, p.get("adapt_vol_p", 34)), (0.0, 0.5), (0.0, 1.5))


@indicator("Force_Context", "event", "feat_force_context", _force_features, source="close", period=13)
def force_context(b, p):
    force = sma(b, f"{change(b, p.source)} * volume", p.period)
    return {"State": b.let(s.case((f"{force} > 0", "1"), (f"{force} < 0", "-1"), otherwise="0")), "RawForce": force}


def _mechanic_features(b, h, p):
    bull, bear, tired = h["Bullish_Force"], h["Bearish_Force"], h["Exhaustion"]
    total = b.let(f"{bull} + {bear} + {tired} + {E}")
    net, share = b.let(s.div(f"{bull} - {bear}", total)), b.let(s.div(tired, total))
    return axis(b, "feat_pvm_position", net, (-1.0, 1.0)) | axis(b, "feat_pvm_bias", from_mean(b, net, p.get("adapt_macro_p", p.volume_ma_period)), (-1.0, 1.0), (-2.0, 2.0)) | axis(b, "feat_pvm_momentum", relative(b, net, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_pvm_volatility", b.ewm(share, p.get("adapt_vol_p", 21)), *HALF_LOG)


@indicator("Price_Volume_Mechanic", "vector", "feat_pvm", _mechanic_features, volume_ma_period=20, volume_multiplier=1.5)
def price_volume(b, p):
    p.positive("volume_ma_period", "volume_multiplier")
    busy = f"volume > {sma(b, 'volume', p.volume_ma_period)} * {s.num(p.volume_multiplier)}"
    part = b.let(s.guarded("abs(close - open)", "high - low"))
    force = lambda condition, x: b.let(s.fill(s.case((f"{busy} AND {condition}", x), otherwise="0e0")))
    return {"Bullish_Force": force("close > open", f"volume * {part}"), "Bearish_Force": force("close < open", f"volume * {part}"), "Exhaustion": force("abs(close - open) < (high - low) * 2e-1", f"volume * (1e0 - {part})")}


def _oscillator_features(b, h, p):
    macro = p.get("adapt_macro_p", p.slow_len)
    x = b.let(standing(b, h["VO"], macro))
    bias = b.let(f"{x} - {b.ewm(x, macro)}")
    near = b.ewm(bias, p.get("adapt_micro_p", p.fast_len))
    return axis(b, "feat_vo_position", x, *THREE) | axis(b, "feat_vo_bias", bias, (-1.0, 1.0), (-3.0, 3.0)) | axis(b, "feat_vo_momentum", s.guarded(f"{bias} - {near}", f"abs({near})", E), *MOMENTUM) | axis(b, "feat_vo_volatility", b.ewm(f"abs({h['VO']}) / 100e0", p.get("adapt_vol_p", p.slow_len), counted=True), (0.0, 1.0), (0.0, 3.0))


@indicator("Volume_Oscillator", "scalar", "feat_vo", _oscillator_features, fast_len=5, slow_len=20)
def volume_oscillator(b, p):
    fast, slow = sma(b, "volume", p.fast_len), sma(b, "volume", p.slow_len)
    return {"VO": b.let(f"100e0 * {s.guarded(f'{fast} - {slow}', slow)}")}
