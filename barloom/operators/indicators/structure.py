"""Swings, breaks, gaps and zones. Swings look ahead by as many rows as they need on the right; ``delayed`` shifts them to where they are known."""

from __future__ import annotations

from barloom.functions import sql as s
from barloom.functions.recurrences import OrderZone
from barloom.functions.series import atr, directional, highest, lowest, pivots, rsi
from barloom.operators.indicators.registry import MOMENTUM, axis, events, from_mean, indicator, relative, rough, standing

E = s.FEATURE_EPS
HALF, FIFTH, HALF_LOG = ((-0.5, 0.5), (-1.0, 1.0)), ((-0.2, 0.2), (-0.5, 0.5)), ((0.0, 0.5), (0.0, 1.0))
UNIT_TWO, RAW = ((-1.0, 1.0), (-2.0, 2.0)), (None,)
flag = lambda condition: s.case((condition, "1"), otherwise="0")


def swings(b, p, left, right, low_of="high"):
    """Whether a row is a swing high, a swing low; the last high and low at such rows. low_of: the column in which lows are sought."""
    delay = right if p.get("confirm_delay") else 0
    high, low = pivots(b, "high", left, right), pivots(b, low_of, left, right)
    is_high, is_low = (b.let(s.fill(b.let(flag(f"{x} = {k}")), "0")) for x, k in ((high, 1), (low, -1)))
    if delay:
        is_high, is_low = (b.let(s.fill(b.lag(x, delay), "0")) for x in (is_high, is_low))
    at_high, at_low = b.let(s.case((f"{is_high} = 1", b.lag("high", delay)))), b.let(s.case((f"{is_low} = 1", b.lag("low", delay))))
    return is_high, is_low, at_high, at_low


def last_two(b, at):
    """The last swing's value, and the one known a row before."""
    last = b.forward(at)
    return last, b.lag(last)


@indicator("BOS_CHOCH", "event", "feat_bos_choch", events("feat_bos_choch", lambda h: (f"{h['Event']} / 2e0", h["Event"]), UNIT_TWO, HALF, FIFTH, HALF_LOG, rescaled=False), left_bars=5, right_bars=5)
def breaks_of_structure(b, p):
    """1, -1: the trend's own break; 2, -2: a break against it."""
    is_high, is_low, at_high, at_low = swings(b, p, p.left_bars, p.right_bars, "low")
    (_, high), (_, low) = last_two(b, at_high), last_two(b, at_low)
    both = f"{is_high} = 1 AND {is_low} = 1"
    trend = b.let(s.case((f"{both} AND high > {high} AND low > {low}", "1"), (f"{both} AND low < {low} AND high < {high}", "-1")))
    trend = b.let(s.fill(b.forward(trend), "0"))
    return {"Event": b.let(s.case((f"{trend} = 1 AND high > {high}", "1"), (f"{trend} = -1 AND low < {low}", "-1"), (f"{trend} = -1 AND high > {high}", "2"), (f"{trend} = 1 AND low < {low}", "-2"), otherwise="0"))}


def _breakout_features(b, h, p):
    x = h["Event"]
    at = b.forward(s.case((f"{x} <> 0", "close")))
    side = f"coalesce({b.forward(s.case((f'{x} <> 0', f'CAST({x} AS DOUBLE)')))}, 1e0)"
    away = f"({s.guarded('close', f'coalesce({at}, close)', E)} - 1e0) * {side}"
    return axis(b, "feat_breakout_momentum", x, *UNIT_TWO) | axis(b, "feat_breakout_position", b.ewm(x, p.get("adapt_macro_p", 21)), *HALF) | axis(b, "feat_breakout_bias", away, (-0.1, 0.1), (-0.3, 0.3)) | axis(b, "feat_breakout_volatility", rough(b, x, p.get("adapt_vol_p", 34)), (0.0, 0.3), (0.0, 0.8))


@indicator("Breakout_Confirmation", "event", "feat_breakout", _breakout_features, pivots_left=5, pivots_right=5, atr_len=14, atr_mult=1.0, volume_window=20, volume_multiplier=1.5)
def breakout(b, p):
    _, _, at_high, at_low = swings(b, p, p.pivots_left, p.pivots_right)
    (_, high), (_, low) = last_two(b, at_high), last_two(b, at_low)
    far = f"{atr(b, p.atr_len)} * {s.num(p.atr_mult)}"
    busy = f"volume > {b.lag(b.over('avg({})', 'volume', p.volume_window))} * {s.num(p.volume_multiplier)}"
    return {"Event": b.let(s.case((f"high > {high} AND close - {high} > {far} AND {busy}", "1"), (f"low < {low} AND {low} - close > {far} AND {busy}", "-1"), otherwise="0"))}


@indicator("Divergence", "event", "feat_divergence", events("feat_divergence", lambda h: (f"{h['Event']} / 2e0", h["Event"]), UNIT_TWO, HALF, FIFTH, HALF_LOG, rescaled=False), source="close", rsi_period=14, p_left=5, p_right=5)
def divergence(b, p):
    """Price and strength disagree at a swing: 2 hidden bullish, 1 bullish, -1 bearish, -2 hidden bearish."""
    strength = rsi(b, p.source, p.rsi_period)
    strength = b.lag(strength, p.p_right) if p.get("confirm_delay") else strength
    is_high, is_low, high, low = swings(b, p, p.p_left, p.p_right)
    at_high, at_low = (b.let(s.case((f"{x} = 1", strength))) for x in (is_high, is_low))
    before = {x: last_two(b, x)[1] for x in (high, low, at_high, at_low)}
    both = lambda x, a, y, c: f"{x} {a} {before[x]} AND {y} {c} {before[y]}"
    return {"Event": b.let(s.case((both(low, ">", at_low, "<"), "2"), (both(low, "<", at_low, ">"), "1"), (both(high, ">", at_high, "<"), "-1"), (both(high, "<", at_high, ">"), "-2"), otherwise="0"))}


def _fvg_features(b, h, p):
    impulse = b.let(s.case((f"{h['isBullish']} = 1", "1e0"), (f"{h['isBearish']} = 1", "-1e0"), otherwise="0e0"))
    top, bottom = (b.let(f"coalesce({b.forward(h[k])}, close)") for k in ("Top", "Bottom"))
    middle = b.let(f"({top} + {bottom}) / 2e0")
    bias = b.let(f"{s.guarded('close', middle, E)} - 1e0")
    return axis(b, "feat_fvg_position", b.ewm(impulse, p.get("adapt_macro_p", 21)), *HALF) | axis(b, "feat_fvg_volatility", s.log1p(s.guarded(f"{top} - {bottom}", middle, E)), (0.0, 0.05), (0.0, 0.2)) | axis(b, "feat_fvg_bias", bias, (-0.1, 0.1), (-0.5, 0.5)) | axis(b, "feat_fvg_momentum", relative(b, bias, p.get("adapt_micro_p", 5)), *MOMENTUM)


@indicator("FVG", "zone", "feat_fvg", _fvg_features)
def fair_value_gap(b, p):
    high, low = b.lag("high", 2), b.lag("low", 2)
    up, down = f"low > {high}", f"high < {low}"
    return {"isBullish": b.let(flag(up)), "isBearish": b.let(flag(down)), "Top": b.let(s.case((up, "low"), (down, low))), "Bottom": b.let(s.case((up, high), (down, "high")))}


def _two_sided(bull, bear):
    def value(h):
        x = s.case((f"{h[bull]} = 1", "1e0"), (f"{h[bear]} = 1", "-1e0"), otherwise="0e0")
        return x, x

    return value


@indicator("Liquidity", "event", "feat_liquidity", events("feat_liquidity", _two_sided("isEQH", "isEQL"), RAW, HALF, FIFTH, HALF_LOG), left=5, right=5, threshold_pct=0.001)
def liquidity(b, p):
    """Swings at about the height of the swing before."""
    is_high, is_low, at_high, at_low = swings(b, p, p.left, p.right, "low")
    (_, high), (_, low) = last_two(b, at_high), last_two(b, at_low)
    near = lambda is_swing, x, before: b.let(flag(f"{is_swing} = 1 AND {s.div(f'abs({x} - {before})', before)} < {s.num(p.threshold_pct)}"))
    return {"isEQH": near(is_high, "high", high), "isEQL": near(is_low, "low", low)}


@indicator("Order_Block", "event", "feat_ob", events("feat_ob", _two_sided("isBullish", "isBearish"), RAW, HALF, FIFTH, HALF_LOG), periods=5, threshold=0.0)
def order_block(b, p):
    open_, close = b.lag("open"), b.lag("close")
    top, bottom = highest(b, b.lag("high"), p.periods), lowest(b, b.lag("low"), p.periods)
    return {"isBullish": b.let(flag(f"close > {top} AND {close} < {open_}")), "isBearish": b.let(flag(f"close < {bottom} AND {close} > {open_}"))}


def _propagation_features(b, h, p):
    age = b.let(standing(b, h["BarsSinceEvent"], p.get("adapt_macro_p", 55)))
    return axis(b, "feat_prop_position", age, (-3.0, 3.0), (-5.0, 5.0)) | axis(b, "feat_prop_momentum", relative(b, age, p.get("adapt_micro_p", 5)), *MOMENTUM) | axis(b, "feat_prop_volatility", rough(b, age, p.get("adapt_vol_p", 34)), *HALF_LOG)


@indicator("Propagation", "scalar", "feat_prop", _propagation_features, left_bars=5, right_bars=5)
def propagation(b, p):
    """Rows since the last structural event. Highs and lows come from one series of swings, so events are as rare as there."""
    _, _, at_high, at_low = swings(b, p, p.left_bars, p.right_bars)
    (last_high, high), (last_low, low) = last_two(b, at_high), last_two(b, at_low)
    trending = f"(({last_high} > {high} AND {last_low} > {low}) OR ({last_high} < {high} AND {last_low} < {low}))"
    row = b.let(f"row_number() OVER ({s.SERIES})")
    event = b.let(s.case((f"{trending} AND (high > {high} OR low < {low})", row)))
    return {"BarsSinceEvent": b.let(f"{row} - coalesce({b.forward(event)}, 0)")}


@indicator("Resonance", "event", "feat_resonance", events("feat_resonance", lambda h: (f"CAST({h['Event']} AS DOUBLE)", h["Event"]), RAW, ((0.0, 0.5), (0.0, 1.0)), ((0.0, 0.2), (0.0, 0.5)), HALF_LOG, macro="ms_adx_len", micro="div_rsi_p", vol="ms_adx_len", rescaled=False), div_rsi_p=14, div_p_left=5, div_p_right=5, ms_di_len=14, ms_adx_len=14)
def resonance(b, p):
    """A bullish divergence outside of trends; price and strength must turn on the same row."""
    strength = rsi(b, "close", p.div_rsi_p)
    price, turn = pivots(b, "high", p.div_p_left, p.div_p_right), pivots(b, strength, p.div_p_left, p.div_p_right)
    low, at = b.let(s.case((f"{price} = -1", "low"))), b.let(s.case((f"{turn} = -1", strength)))
    trend = directional(b, p.ms_di_len, p.ms_adx_len)[2]
    return {"Event": b.let(flag(f"{low} < {last_two(b, low)[1]} AND {at} > {last_two(b, at)[1]} AND NOT {trend} > 25e0"))}


def _smc_features(b, h, p):
    of = lambda up, down, weight: f"({h[up]} - {h[down]}) * {weight}"
    score = b.let(f"{of('isUptrend', 'isDowntrend', '4e-1')} + {of('obBull', 'obBear', '4e-1')} + {of('fvgBull', 'fvgBear', '2e-1')}")
    macro = p.get("adapt_macro_p", 55)
    return axis(b, "feat_smc_position", b.ewm(score, macro), (-0.8, 0.8), (-1.0, 1.0)) | axis(b, "feat_smc_bias", from_mean(b, score, macro), *UNIT_TWO) | axis(b, "feat_smc_momentum", relative(b, score, p.get("adapt_micro_p", 13)), *MOMENTUM) | axis(b, "feat_smc_volatility", rough(b, score, p.get("adapt_vol_p", 34)), *HALF_LOG)


@indicator("SMC_Context", "vector", "feat_smc", _smc_features, p_left=5, p_right=5, liq_left=5, liq_right=5, liq_thresh_pct=0.001, ob_p=3, ob_thresh=1.5)
def smc(b, p):
    """Structure, gaps, equal swings and order blocks of one market, as flags."""
    _, _, at_high, at_low = swings(b, p, p.p_left, p.p_right)
    (last_high, high), (last_low, low) = last_two(b, at_high), last_two(b, at_low)
    reach = lambda agg, x: b.lag(b.so_far(agg, x))
    up = b.let(flag(f"{last_high} > {reach('max({})', last_high)} AND {last_low} > {reach('max({})', last_low)}"))
    down = b.let(flag(f"{last_high} < {reach('min({})', last_high)} AND {last_low} < {reach('min({})', last_low)}"))
    gap = fair_value_gap(b, p)
    is_high, is_low, eq_high, eq_low = swings(b, p, p.liq_left, p.liq_right)
    equal = lambda x: b.let(flag(f"{s.guarded(f'abs({x} - {last_two(b, x)[1]})', last_two(b, x)[1])} < {s.num(p.liq_thresh_pct)}"))
    moved = f"abs(close - {b.lag('close', p.ob_p)}) > {atr(b, 14)} * {s.num(p.get('ob_thresh', 1.5))}"
    red, green = f"{b.lag('close')} < {b.lag('open')}", f"{b.lag('close')} > {b.lag('open')}"
    bull, bear = b.let(flag(f"{red} AND {moved} AND close > open")), b.let(flag(f"{green} AND {moved} AND close < open"))
    held_bull, held_bear = b.scan(OrderZone, [bull, b.lag("low"), "low"], 1.0)[0], b.scan(OrderZone, [bear, b.lag("high"), "high"], -1.0)[0]
    parts = {"isUptrend": up, "isDowntrend": down, "fvgBull": gap["isBullish"], "fvgBear": gap["isBearish"], "obBull": held_bull, "obBear": held_bear}
    breaks = {name: b.let(flag(f"{trend} = 1 AND {cond}")) for name, trend, cond in (("bosBull", up, f"high > {high}"), ("chochBear", up, f"low < {low}"), ("bosBear", down, f"low < {low}"), ("chochBull", down, f"high > {high}"))}
    return parts | breaks | {"isEQH": equal(eq_high), "isEQL": equal(eq_low), "pivots": pivots(b, "high", p.p_left, p.p_right)}


@indicator("Trap", "event", "feat_trap", events("feat_trap", lambda h: (f"{h['Event']} / 2e0", h["Event"]), UNIT_TWO, HALF, FIFTH, HALF_LOG, micro="confirm_window"), pivots_left=5, pivots_right=5, confirm_window=3)
def trap(b, p):
    """1, -1: a break of the last swing; 2, -2: one that failed within the window."""
    _, _, at_high, at_low = swings(b, p, p.pivots_left, p.pivots_right)
    (last_high, high), (last_low, low) = last_two(b, at_high), last_two(b, at_low)
    up, down = b.let(flag(f"high > {high}")), b.let(flag(f"low < {low}"))
    k = p.confirm_window
    return {"Event": b.let(s.case((f"{b.lag(up, k)} = 1 AND close < {b.lag(last_high, k)}", "2"), (f"{b.lag(down, k)} = 1 AND close > {b.lag(last_low, k)}", "-2"), (f"{up} = 1", "1"), (f"{down} = 1", "-1"), otherwise="0"))}
