"""One series against others that stand beside it in the row."""

from __future__ import annotations

from barloom.functions import sql as s
from barloom.functions.series import correlation, covariance, plain_zscore, stddev
from barloom.operators.indicators.registry import around, indicator

HALF, HALF_LOG, UNIT = ((-0.5, 0.5), (-1.0, 1.0)), ((0.0, 0.5), (0.0, 1.0)), ((-1.0, 1.0), (-1.0, 1.0))


def per_series(prefix, key, position, bias, volatility):
    """The common features once for each other series."""

    def features(b, h, p):
        out = {}
        for suffix in "bcd":
            if (name := f"{key}_{suffix}") in h:
                out |= around(f"{prefix}_{suffix}", lambda h, p, name=name: h[name], position, bias, volatility, "window", 5, "window")(b, h, p)
        return out

    return features


@indicator("Global_Context", "scalar", "feat_global_context", around("feat_global_context", lambda h, p: h["Correlation"], UNIT, HALF, HALF_LOG, 21, 5, 34), series_a="close", series_b="series_b", corr_window=30)
def global_context(b, p):
    return {"Correlation": correlation(b, p.series_a, p.series_b, p.corr_window)}


@indicator("Rolling_Correlation", "vector", "feat_rolling_corr", per_series("feat_rolling_corr", "Corr", UNIT, HALF, HALF_LOG), series_a="close", series_b="series_b", series_c="series_c", window=30)
def rolling_correlation(b, p):
    return {f"Corr_{x}": correlation(b, p.series_a, p[f"series_{x}"], p.window) for x in "bc" if f"series_{x}" in p}


@indicator("Rolling_Cointegration", "vector", "feat_coint", per_series("feat_coint", "Spread_ZScore", ((-3.0, 3.0), (-6.0, 6.0)), ((-1.0, 1.0), (-3.0, 3.0)), ((0.0, 1.0), (0.0, 2.0))), series_a="close", series_b="series_b", series_c="series_c", series_d=None, window=30)
def rolling_cointegration(b, p):
    out = {}
    for x in "bcd":
        if f"series_{x}" in p:
            other = p[f"series_{x}"]
            wide = stddev(b, other, p.window)
            ratio = b.let(s.guarded(covariance(b, p.series_a, other, p.window), f"{wide} * {wide}"))
            spread = b.let(f"{p.series_a} - {ratio} * {other}")
            out |= {f"HedgeRatio_{x}": ratio, f"Spread_ZScore_{x}": b.let(plain_zscore(b, spread, p.window))}
    return out
