"""Scores that weigh several baskets of price-action signals, and the chain that makes all of them from candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators import levels, patterns, recursive, rolling
from sandpiper.operators.rolling import prev, ratio
from sandpiper.sources.candles import series

#: Fixed: the share of each basket in the score, and what each signal adds to its basket; a basket is kept within 0 .. 1 after each group.
BASKETS = {"structure": 0.30, "zones": 0.30, "imbalance": 0.20, "mtf": 0.20, "extras": 0.00}
ADDS: dict[str, tuple[dict[str, float], ...]] = {
    "structure": ({"bos": 0.5, "choch": 0.35}, {"structure": 0.15}), "zones": ({"sd_near": 0.6, "ob_near": 0.6},), "imbalance": ({"fvg_near": 0.6, "sweep": 0.25},),
    "mtf": ({"confluence": 0.8, "conflict": -0.5}, {"bias_high": 0.2}),
    "extras": ({"trend": 0.45, "spike": 0.25, "range": -0.20, "break_up": 0.20, "break_down": 0.20, "retest_up": 0.10, "retest_down": 0.10, "fail_up": -0.15, "fail_down": -0.15, "mc": 0.15, "mc_quality": 0.20},),
}


def nearness(distance: Column) -> Column:
    """1 at no distance falling towards 0; a null one counts as 0."""
    return F.coalesce(1 / (1 + distance), F.lit(0.0))


def zone_distance(bottom: str, top: str, atr: str = "atr") -> Column:
    """How far the close is from the newest zone, in ATR; 0 inside it, null before any."""
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.last(bottom, True).over(upto), F.last(top, True).over(upto)
    return ratio(F.greatest(lo - F.col("close"), F.col("close") - hi, lo * 0), F.col(atr))


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def score(df: DataFrame, signals: dict[str, Column], weights: dict[str, float] | None = None, strong: float = 0.7, passes: float = 0.35, delay: int = 1) -> DataFrame:
    """conf_structure, conf_zones, conf_imbalance, conf_mtf, conf_extras, conf_score, conf_strong, conf_pass.

    signals: named as in ADDS, each a number; those not given add nothing, null counts as 0. A basket is the sum of what its
    signals add, group after group, within 0 .. 1; the score is their mean by weight. All are those of ``delay`` bars before (score 0.5 and
    flags 0 where there is none).
    """
    share = BASKETS | (weights or {})
    total = max(1e-9, sum(share.values()))
    out = df
    for basket, groups in ADDS.items():
        value = F.lit(0.0)
        for adds in groups:
            for name in (n for n in adds if n in signals):
                value = value + adds[name] * F.coalesce(signals[name].cast("double"), F.lit(0.0))
            value = clip01(value)
        out = out.withColumn(f"__{basket}", value)
    out = out.withColumn("__score", clip01(sum((F.col(f"__{b}") * (w / total) for b, w in share.items()), F.lit(0.0))))
    late = {f"conf_{b}": prev(f"__{b}", delay) for b in ADDS} | {"__late": prev("__score", delay)}
    out = out.withColumns(late)
    return out.withColumns({
        "conf_score": F.coalesce("__late", F.lit(0.5)), "conf_strong": patterns.flag(F.col("__late") >= strong), "conf_pass": patterns.flag(F.col("__late") >= passes),
    }).drop("__late", "__score", *(f"__{b}" for b in ADDS))


def price_action(df: DataFrame, reversal: float = 0.05, weights: dict[str, float] | None = None) -> DataFrame:
    """All price-action columns of a series and their confluence score: structure, zones, imbalance, bias, regime, breaks, channels.

    The bias of the longer view is that of windows four times as long. Every stage is windows over one partitioning, save
    the swings, which take one ordered pass.
    """
    out = rolling.atr_classic(rolling.truerange(recursive.zigzag(df, reversal)))
    out = patterns.market_structure(out)
    out = patterns.order_block(patterns.supply_demand(out))
    out = patterns.liquidity_sweep(patterns.fair_value_gap(out))
    out = levels.confluence(levels.soft_bias(levels.soft_bias(out), window=32, least=16, out="bias_high"))
    out = patterns.regime(out)
    out = patterns.break_outcomes(patterns.breakouts(out))
    out = patterns.microchannels(out)
    near = lambda z: nearness(F.col(f"__d_{z}"))
    out = out.withColumns({f"__d_{z}": zone_distance(f"{z}_bottom", f"{z}_top") for z in ("sd", "ob", "fvg")})
    signals = {
        "bos": F.abs("bos"), "choch": F.abs("choch"), "structure": F.col("structure").isin("HH", "LL").cast("int"), "sd_near": near("sd"), "ob_near": near("ob"), "fvg_near": near("fvg"), "sweep": F.abs("sweep"),
        "confluence": F.coalesce("confluence", F.lit(0.5)), "conflict": F.col("conflict"), "bias_high": F.abs("bias_high"), "mc": F.abs("mc"), "mc_quality": F.col("mc_quality"),
        **{k: (F.col("regime_label") == k).cast("int") for k in ("trend", "spike", "range")}, **{k: F.col(k) for k in ("break_up", "break_down", "retest_up", "retest_down", "fail_up", "fail_down")},
    }
    return score(out, signals, weights).drop("__d_sd", "__d_ob", "__d_fvg")
