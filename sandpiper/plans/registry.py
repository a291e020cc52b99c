"""The indicators that specifications can name."""

from __future__ import annotations

from sandpiper.functions.spec import Feature, Param
from sandpiper.operators import recursive as r
from sandpiper.operators import rolling as w

COLUMN = Param("column", str, "close", ("source", "src"), ("open", "high", "low", "close"))


def period(default: int, least: int = 1) -> Param:
    return Param("period", int, default, ("n", "length", "window"), least=least)


MINP = Param("min_periods", int, -1, ("minp",), least=-1)
ALL = (
    Feature("sma", w.sma, (COLUMN, period(20), MINP), ("sma",)),
    Feature("wma", w.wma, (COLUMN, period(20), MINP), ("wma",)),
    Feature("ema", r.ema, (COLUMN, period(20), MINP), ("ema",)),
    Feature("roc", w.roc, (COLUMN, period(10)), ("roc",), lambda p: p["period"] + 1),
    Feature("rsi", r.rsi, (COLUMN, period(14), Param("method", str, "ema", (), ("ema", "wilders"))), ("rsi",), lambda p: p["period"] + 1),
    Feature("true_range", w.truerange, (), ("true_range",), lambda p: 1, ("high", "low", "close")),
    Feature("atr", lambda df, period, method: w.atr_classic(df, period) if method == "classic" else r.atr(df, period, method), (period(14), Param("method", str, "wilder", (), ("classic", "wilder", "ema"))), ("atr",), requires=("high", "low", "close")),
    Feature("macd", r.macd, (COLUMN, Param("fast", int, 12, least=1), Param("slow", int, 26, least=1), Param("signal", int, 9, least=1)), ("macd", "macd_signal", "macd_hist"), lambda p: max(p["fast"], p["slow"]) + p["signal"] - 1),
    Feature("bollinger_bands", w.bollinger, (COLUMN, period(20), Param("multiplier", float, 2.0, ("std_dev", "k"), least=0), MINP), ("bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent")),
    Feature("keltner", r.keltner, (period(20), Param("multiplier", float, 2.0, ("m",), least=0)), ("kc_upper", "kc_middle", "kc_lower", "kc_width", "kc_percent"), requires=("high", "low", "close")),
    Feature("stochastic", w.stochastic, (Param("k_period", int, 14, ("k",), least=1), Param("d_period", int, 3, ("d",), least=1), Param("smooth_k", int, 3, least=1)), ("stoch_k", "stoch_d"), lambda p: p["k_period"] + p["smooth_k"] + p["d_period"] - 2, ("high", "low", "close")),
    Feature("cci", w.cci, (period(20), MINP), ("cci",), requires=("high", "low", "close")),
    Feature("mfi", w.mfi, (period(14),), ("mfi",), lambda p: p["period"] + 1, ("high", "low", "close", "volume")),
    Feature("obv", w.obv, (), ("obv",), lambda p: 1, ("close", "volume")),
    Feature("williams_r", w.williamsr, (period(14), MINP), ("williamsr",), requires=("high", "low", "close")),
    Feature("parabolic_sar", r.parabolic_sar, (Param("af_start", float, 0.02, least=0), Param("af_step", float, 0.02, least=0), Param("af_max", float, 0.2, least=0)), ("psar",), lambda p: 2, ("high", "low")),
    Feature("heikin_ashi", r.heikin_ashi, (), ("ha_open", "ha_high", "ha_low", "ha_close"), lambda p: 1, ("open", "high", "low", "close")),
    Feature("supertrend", r.supertrend, (period(10), Param("multiplier", float, 3.0, least=0)), ("supertrend", "supertrend_dir"), requires=("high", "low", "close")),
    Feature("aroon", w.aroon, (period(25),), ("aroon_up", "aroon_down", "aroon_osc"), requires=("high", "low")),
    Feature("dema", r.dema, (COLUMN, period(20), MINP), ("dema",), lambda p: 2 * p["period"] - 1),
    Feature("tema", r.tema, (COLUMN, period(20), MINP), ("tema",), lambda p: 3 * p["period"] - 2),
    Feature("kama", r.kama, (COLUMN, period(10, 2), Param("fast_span", int, 2, least=1), Param("slow_span", int, 30, least=1)), ("kama",)),
    Feature("hma", w.hma, (COLUMN, period(20, 2)), ("hma",), lambda p: p["period"] + int(p["period"] ** 0.5) - 1),
    Feature("donchian", lambda df, period: w.donchian(df, period), (period(20),), ("dc_upper", "dc_lower", "dc_mid", "dc_width", "dc_pos"), requires=("high", "low", "close")),
    Feature("zscore", lambda df, column, period: w.zscore(df, column, period), (COLUMN, period(20, 2)), ("zscore",)),
    Feature("linreg_slope", lambda df, column, period: w.linreg_slope(df, column, period), (COLUMN, period(14, 2)), ("slope",)),
    Feature("adx", r.adx, (period(14),), ("plus_di", "minus_di", "adx"), lambda p: 2 * p["period"], ("high", "low", "close")),
)
REGISTRY = {f.name: f for f in ALL}
REGISTRY |= {"bollinger": REGISTRY["bollinger_bands"], "bb": REGISTRY["bollinger_bands"], "psar": REGISTRY["parabolic_sar"], "tr": REGISTRY["true_range"], "williamsr": REGISTRY["williams_r"]}
