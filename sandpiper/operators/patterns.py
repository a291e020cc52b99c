"""Candle patterns: 0/1 flags from a bar and the few before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators.recursive import rolling_quantiles
from sandpiper.operators.rolling import highest, linreg_slope, lowest, prev, ratio
from sandpiper.sources.candles import KEY, series



def flag(test: Column) -> Column:
    return F.coalesce(test.cast("int"), F.lit(0))


def parts() -> tuple[Column, Column, Column, Column]:
    """Body, upper wick, lower wick, range."""
    return F.abs(F.col("close") - F.col("open")), F.col("high") - F.greatest(F.col("open"), F.col("close")), F.least(F.col("open"), F.col("close")) - F.col("low"), F.col("high") - F.col("low")


def engulfing(df: DataFrame) -> DataFrame:
    po, pc = prev("open"), prev("close")
    return df.withColumns({"engulf_bull": flag((pc < po) & (F.col("close") > F.col("open")) & (F.col("close") >= po) & (F.col("open") <= pc)), "engulf_bear": flag((pc > po) & (F.col("close") < F.col("open")) & (F.col("open") >= pc) & (F.col("close") <= po))})


def doji(df: DataFrame, share: float = 0.2, atr: str | None = None, atr_share: float = 0.1) -> DataFrame:
    """Body small against the bar's range, and against ATR where a column of it is named."""
    body, _, _, span = parts()
    small = ratio(body, span) <= share
    return df.withColumn("doji", flag(small if atr is None else small & (ratio(body, F.col(atr)) <= atr_share)))


def pinbar(df: DataFrame, times: float = 2.0) -> DataFrame:
    body, up, down, _ = parts()
    return df.withColumns({"pin_bull": flag((down >= times * body) & (up <= body)), "pin_bear": flag((up >= times * body) & (down <= body))})


def hammer_star(df: DataFrame, times: float = 2.0, other: float = 1.25, least_body: float = 0.0) -> DataFrame:
    body, up, down, span = parts()
    full = ratio(body, span) >= least_body
    return df.withColumns({"hammer": flag(full & (down >= times * body) & (up <= other * body)), "shooting_star": flag(full & (up >= times * body) & (down <= other * body))})


def harami(df: DataFrame) -> DataFrame:
    po, pc = prev("open"), prev("close")
    inside = (F.greatest(F.col("open"), F.col("close")) <= F.greatest(po, pc)) & (F.least(F.col("open"), F.col("close")) >= F.least(po, pc))
    return df.withColumns({"harami_bull": flag((pc < po) & (F.col("close") > F.col("open")) & inside), "harami_bear": flag((pc > po) & (F.col("close") < F.col("open")) & inside)})


def inside_outside(df: DataFrame, atr: str | None = None, least: float = 0.0, strict: bool = True) -> DataFrame:
    """A bar within the last one's range, or around it; equal ends count unless ``strict``. With an ATR column the range has to be ``least`` of it."""
    ph, pl, h, lo = prev("high"), prev("low"), F.col("high"), F.col("low")
    inside, outside = ((h < ph) & (lo > pl), (h > ph) & (lo < pl)) if strict else ((h <= ph) & (lo >= pl), (h >= ph) & (lo <= pl))
    wide = F.lit(True) if atr is None else h - lo >= least * F.nullif(F.col(atr), F.lit(0.0))
    return df.withColumns({"inside_bar": flag(inside & wide), "outside_bar": flag(outside & wide)})


def marubozu(df: DataFrame, share: float = 0.1) -> DataFrame:
    _, up, down, span = parts()
    small = (ratio(up, span) <= share) & (ratio(down, span) <= share)
    return df.withColumns({"marubozu_bull": flag(small & (F.col("close") > F.col("open"))), "marubozu_bear": flag(small & (F.col("close") < F.col("open")))})


def tweezer(df: DataFrame, share: float = 0.001, atr: str | None = None) -> DataFrame:
    """Two highs, or lows, no further apart than a share of price; with an ATR column, than ``share`` times what it is of the bar's middle."""
    ph, pl = prev("high"), prev("low")
    if atr is not None:
        reach = share * ratio(F.nullif(F.col(atr), F.lit(0.0)), (F.col("high") + F.col("low")) / 2)
        return df.withColumns({"tweezer_top": flag(F.abs(F.col("high") - ph) <= reach * F.abs(ph)), "tweezer_bottom": flag(F.abs(F.col("low") - pl) <= reach * F.abs(pl))})
    return df.withColumns({"tweezer_top": flag(ratio(F.abs(F.col("high") - ph), ph) <= share), "tweezer_bottom": flag(ratio(F.abs(F.col("low") - pl), pl) <= share)})


def three_in_a_row(df: DataFrame) -> DataFrame:
    """Three bars of one direction, each closing beyond the last."""
    up = (F.col("close") > F.col("open")) & (prev("close") > prev("open")) & (prev("close", 2) > prev("open", 2)) & (F.col("close") > prev("close")) & (prev("close") > prev("close", 2))
    down = (F.col("close") < F.col("open")) & (prev("close") < prev("open")) & (prev("close", 2) < prev("open", 2)) & (F.col("close") < prev("close")) & (prev("close") < prev("close", 2))
    return df.withColumns({"three_soldiers": flag(up), "three_crows": flag(down)})


def strong_three(df: DataFrame, atr: str, least: float = 0.2) -> DataFrame:
    """strong_soldiers, strong_crows: three bars of one direction whose bodies are each ``least`` of ATR."""
    body = F.col("close") - F.col("open")
    out = df.withColumn("__s", F.when(ratio(F.abs(body), F.col(atr)) >= least, F.signum(body)))
    three = lambda way: flag((F.col("__s") == way) & (prev("__s") == way) & (prev("__s", 2) == way))
    return out.withColumns({"strong_soldiers": three(1), "strong_crows": three(-1)}).drop("__s")


def stars(df: DataFrame, small: float = 0.3) -> DataFrame:
    """A long bar, a small one, and a close beyond the middle of the first."""
    o2, c2, b2 = prev("open", 2), prev("close", 2), F.abs(prev("close", 2) - prev("open", 2))
    tiny = F.abs(prev("close") - prev("open")) <= small * b2
    middle = (o2 + c2) / 2
    return df.withColumns({"morning_star": flag((c2 < o2) & tiny & (F.col("close") > F.col("open")) & (F.col("close") >= middle)), "evening_star": flag((c2 > o2) & tiny & (F.col("close") < F.col("open")) & (F.col("close") <= middle))})


def piercing(df: DataFrame) -> DataFrame:
    po, pc = prev("open"), prev("close")
    middle = (po + pc) / 2
    return df.withColumns({"piercing": flag((pc < po) & (F.col("close") > F.col("open")) & (F.col("open") < pc) & (F.col("close") > middle) & (F.col("close") < po)), "dark_cloud": flag((pc > po) & (F.col("close") < F.col("open")) & (F.col("open") > pc) & (F.col("close") < middle) & (F.col("close") > po))})


def belt_hold(df: DataFrame, share: float = 0.1) -> DataFrame:
    _, _, _, span = parts()
    return df.withColumns({"belt_bull": flag((F.col("close") > F.col("open")) & (ratio(F.col("open") - F.col("low"), span) <= share)), "belt_bear": flag((F.col("close") < F.col("open")) & (ratio(F.col("high") - F.col("open"), span) <= share))})


ALL = (engulfing, doji, pinbar, hammer_star, harami, inside_outside, marubozu, tweezer, three_in_a_row, stars, piercing, belt_hold)


def all_patterns(df: DataFrame) -> DataFrame:
    for pattern in ALL:
        df = pattern(df)
    return df


# -- zones and breaks ---------------------------------------------------------


def fair_value_gap(df: DataFrame, lookback: int = 2, atr: str | None = None, least: float = 0.5, middle: bool = True) -> DataFrame:
    """fvg (1 bullish, -1 bearish), its bottom and top, given one bar after the gap shows.

    With an ATR column the gap has to be ``least`` of it, and, with ``middle``, so has the body of the bar before.
    """
    ph, pl = prev("high", lookback), prev("low", lookback)
    up, down = ph < F.col("low"), pl > F.col("high")
    if atr is not None:
        reach = least * F.col(atr)
        body = F.abs(prev("close") - prev("open")) >= reach if middle else F.lit(True)
        up, down = up & (F.col("low") - ph >= reach) & body, down & (pl - F.col("high") >= reach) & body
    out = df.withColumn("__k", F.when(up, 1).when(down, -1).otherwise(0))
    bottom = F.when(F.col("__k") == 1, ph).when(F.col("__k") == -1, F.col("high"))
    top = F.when(F.col("__k") == 1, F.col("low")).when(F.col("__k") == -1, pl)
    out = out.withColumns({"__b": bottom, "__t": top})
    return out.withColumns({"fvg": F.coalesce(prev("__k"), F.lit(0)), "fvg_bottom": prev("__b"), "fvg_top": prev("__t")}).drop("__k", "__b", "__t")


def liquidity_sweep(df: DataFrame, lookback: int = 5, least_tail: float = 0.5, atr: str = "atr") -> DataFrame:
    """A wick beyond the extreme of the bars before that closes back inside; sweep is flagged on the next bar, the levels on its own."""
    past = series().rowsBetween(-lookback, -1)
    high, low = F.max("high").over(past), F.min("low").over(past)
    _, up, down, _ = parts()
    out = df.withColumns({"__hi": high, "__lo": low})
    bear = F.coalesce((F.col("high") > F.col("__hi")) & (F.col("close") < F.col("__hi")) & (ratio(up, F.col(atr)) >= least_tail), F.lit(False))
    bull = F.coalesce((F.col("low") < F.col("__lo")) & (F.col("close") > F.col("__lo")) & (ratio(down, F.col(atr)) >= least_tail), F.lit(False))
    out = out.withColumn("__k", F.when(bear, -1).when(bull, 1).otherwise(0))
    return out.withColumns({
        "sweep": F.coalesce(prev("__k"), F.lit(0)),
        "sweep_top": F.when(F.col("__k") == -1, F.col("high")).when(F.col("__k") == 1, F.col("__lo")),
        "sweep_bottom": F.when(F.col("__k") == -1, F.col("__hi")).when(F.col("__k") == 1, F.col("low")),
    }).drop("__hi", "__lo", "__k")


def supply_demand(df: DataFrame, base: int = 3, base_most: float = 0.6, impulse_least: float = 1.2, atr: str = "atr") -> DataFrame:
    """A base of ``base`` quiet bars left by a strong one: sd is 1 (demand) or -1 (supply), with the base's bottom and top."""
    before = series().rowsBetween(-base, -1)
    body, _, _, span = parts()
    quiet = df.withColumn("__q", flag(ratio(span, F.col(atr)) <= base_most))
    strong = (ratio(span, F.col(atr)) >= impulse_least) & (ratio(body, span) >= 0.55) & (F.sum("__q").over(before) == base)
    kind = F.when(strong & (F.col("close") > F.col("open")), 1).when(strong & (F.col("close") < F.col("open")), -1).otherwise(0)
    out = quiet.withColumns({"sd": kind, "__b": F.min("low").over(before), "__t": F.max("high").over(before)})
    return out.withColumns({"sd_bottom": F.when(F.col("sd") != 0, F.col("__b")), "sd_top": F.when(F.col("sd") != 0, F.col("__t"))}).drop("__q", "__b", "__t")


def order_block(df: DataFrame, lookback: int = 5) -> DataFrame:
    """The last bar against the break when price closes beyond the extreme of ``lookback`` bars; flagged one bar later."""
    past = series().rowsBetween(-lookback, -1)
    out = df.withColumn("__k", F.when(F.col("close") > F.max("high").over(past), 1).when(F.col("close") < F.min("low").over(past), -1).otherwise(0))
    last = lambda test, v: F.last(F.when(test, v), True).over(past)
    bottom = F.when(F.col("__k") == 1, last(F.col("close") < F.col("open"), F.col("low"))).when(F.col("__k") == -1, last(F.col("close") > F.col("open"), F.col("low")))
    top = F.when(F.col("__k") == 1, last(F.col("close") < F.col("open"), F.col("high"))).when(F.col("__k") == -1, last(F.col("close") > F.col("open"), F.col("high")))
    out = out.withColumns({"__b": bottom, "__t": top})
    return out.withColumns({"ob": F.when(prev("__t").isNotNull(), prev("__k")).otherwise(0), "ob_bottom": prev("__b"), "ob_top": prev("__t")}).drop("__k", "__b", "__t")


def strong_order_block(df: DataFrame, atr: str, least_body: float = 0.6, most_wick: float = 0.6, lookback: int = 5) -> DataFrame:
    """ob (1, -1) on the bar after a close beyond the extreme of ``lookback`` bars, with the body of the last strong bar against it.

    Strong is a body of least_body of ATR or more whose wicks are together at most most_wick of it.
    """
    body, _, _, span = parts()
    past, upto = series().rowsBetween(-lookback, -1), series().rowsBetween(Window.unboundedPreceding, 0)
    strong = (ratio(body, F.col(atr)) >= least_body) & (ratio(span - body, body) <= most_wick)
    way = F.signum(F.col("close") - F.col("open"))
    out = df.withColumns({"__u": flag(F.col("close") > F.max("high").over(past)), "__d": flag(F.col("close") < F.min("low").over(past)), "__s": F.when(strong, way)})
    last = lambda kind, c: F.last(F.when(F.col("__s") == kind, F.col(c)), True).over(upto)
    out = out.withColumns({"__bt": last(-1, "open"), "__bb": last(-1, "close"), "__rt": last(1, "close"), "__rb": last(1, "open")})
    bull, bear = (prev("__u") == 1) & F.col("__bt").isNotNull(), (prev("__d") == 1) & F.col("__rt").isNotNull()
    return out.withColumns({
        "ob": F.when(bull, 1).when(bear, -1).otherwise(0), "ob_bottom": F.when(bull, F.col("__bb")).when(bear, F.col("__rb")), "ob_top": F.when(bull, F.col("__bt")).when(bear, F.col("__rt")),
    }).drop("__u", "__d", "__s", "__bt", "__bb", "__rt", "__rb")


def run_length(df: DataFrame, test: str, out: str) -> DataFrame:
    """How many rows in a row, this one included, have ``test`` (0/1)."""
    step = df.withColumn("__g", F.sum(1 - F.col(test)).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*KEY, "__g").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn(out, F.sum(test).over(own)).drop("__g")


def breakouts(df: DataFrame, window: int = 20, least: int = 10, closes: int = 1) -> DataFrame:
    """break_up, break_down: at least ``closes`` closes in a row beyond the range of the ``window`` bars before; known on the next bar."""
    out = df.withColumns({"range_high": highest("high", window, least), "range_low": lowest("low", window, least)})
    out = out.withColumns({"__a": flag(F.col("close") > prev("range_high")), "__b": flag(F.col("close") < prev("range_low"))})
    out = run_length(run_length(out, "__a", "__ra"), "__b", "__rb")
    out = out.withColumns({"__u": flag(F.col("__ra") >= closes), "__d": flag(F.col("__rb") >= closes)})
    return out.withColumns({"break_up": F.coalesce(prev("__u"), F.lit(0)), "break_down": F.coalesce(prev("__d"), F.lit(0))}).drop("__a", "__b", "__ra", "__rb", "__u", "__d")


def break_outcomes(df: DataFrame, window: int = 20, least: int = 10, closes: int = 1, retest: int = 5, fail: int = 3, known: bool = True) -> DataFrame:
    """retest_up, retest_down, fail_up, fail_down for breaks of breakouts(): within ``retest`` bars price comes back to the level
    that was broken, within ``fail`` bars it closes on the other side again.

    What becomes of a break shows only later. With ``known`` the flags stand max(retest, fail) bars after it, where all of
    this is past; without, on the bar after the break, which looks ahead (older definitions do so).
    """
    out = df.withColumns({"__hi": prev(highest("high", window, least)), "__lo": prev(lowest("low", window, least))})
    out = out.withColumns({"__a": flag(F.col("close") > F.col("__hi")), "__b": flag(F.col("close") < F.col("__lo"))})
    out = run_length(run_length(out, "__a", "__ra"), "__b", "__rb")
    ahead = lambda n: series().rowsBetween(1, n)
    up, down = F.col("__ra") >= closes, F.col("__rb") >= closes
    out = out.withColumns({
        "__0": flag(up & (F.min("low").over(ahead(retest)) <= F.col("__hi"))), "__1": flag(down & (F.max("high").over(ahead(retest)) >= F.col("__lo"))),
        "__2": flag(up & (F.min("close").over(ahead(fail)) < F.col("__hi"))), "__3": flag(down & (F.max("close").over(ahead(fail)) > F.col("__lo"))),
    })
    late = max(retest, fail) if known else 1
    names = ("retest_up", "retest_down", "fail_up", "fail_down")
    return out.withColumns({name: F.coalesce(prev(f"__{k}", late), F.lit(0)) for k, name in enumerate(names)}).drop("__hi", "__lo", "__a", "__b", "__ra", "__rb", *(f"__{k}" for k in range(4)))


def microchannels(df: DataFrame, least: int = 3, near: float = 0.2) -> DataFrame:
    """Runs of bars that close near their extreme or keep raising their low (lowering their high): mc is 1, -1 or 0, with its length.

    mc_quality: the mean of two shares of the run's bars, of those that close near the extreme and of those that move on.
    """
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    flags = {
        "u": ((F.col("high") - F.col("close")) / span <= near, F.col("low") > prev("low")),
        "d": ((F.col("close") - F.col("low")) / span <= near, F.col("high") < prev("high")),
    }
    out = df.withColumns({f"__n{k}": flag(a) + flag(b) for k, (a, b) in flags.items()})
    for k in flags:
        out = run_length(out.withColumn(f"__{k}", (F.col(f"__n{k}") > 0).cast("int")), f"__{k}", f"__r{k}")
        # the bar before a run has neither sign, so sums over the run may start on it
        out = out.withColumn(f"__i{k}", F.sum(1 - F.col(f"__{k}")).over(series().rowsBetween(Window.unboundedPreceding, 0)))
        run = Window.partitionBy(*KEY, f"__i{k}").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"__s{k}", F.sum(f"__n{k}").over(run))
    kind = F.when((F.col("__ru") >= least) & (F.col("__ru") >= F.col("__rd")), 1).when(F.col("__rd") >= least, -1).otherwise(0)
    out = out.withColumn("mc", kind)
    of = lambda up, down, zero: F.when(F.col("mc") == 1, up).when(F.col("mc") == -1, down).otherwise(zero)
    out = out.withColumns({"mc_length": of(F.col("__ru"), F.col("__rd"), 0), "mc_quality": of(F.col("__su") / F.col("__ru") / 2, F.col("__sd") / F.col("__rd") / 2, 0.0)})
    return out.drop(*(f"__{c}{k}" for c in ("", "n", "r", "i", "s") for k in flags))


def market_structure(df: DataFrame, swing: str = "zz", price: str = "zz_price", eps: float = 1e-6) -> DataFrame:
    """structure (HH, HL, LH, LL) of each swing, and bos / choch: closes beyond the last swing with or against the standing regime."""
    upto, past = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(Window.unboundedPreceding, -1)
    pick = lambda kind, w: F.last(F.when(F.col(swing) == kind, F.col(price)), True).over(w)
    out = df.withColumns({"last_high": pick(1, upto), "last_low": pick(-1, upto), "__ph": pick(1, past), "__pl": pick(-1, past)})
    label = F.when((F.col(swing) == 1) & (F.col(price) > F.col("__ph")), "HH").when((F.col(swing) == 1) & (F.col(price) < F.col("__ph")), "LH").when((F.col(swing) == -1) & (F.col(price) > F.col("__pl")), "HL").when((F.col(swing) == -1) & (F.col(price) < F.col("__pl")), "LL")
    event = F.when(F.col("close") >= F.col("last_high") * (1 + eps), 1).when(F.col("close") <= F.col("last_low") * (1 - eps), -1)
    out = out.withColumns({"structure": label, "__e": event})
    out = out.withColumns({"__r": F.last("__e", True).over(past), "regime": F.coalesce(F.last("__e", True).over(upto), F.lit(0))})
    same = F.col("__e") == F.coalesce("__r", F.lit(0))
    return out.withColumns({"bos": F.when(same, F.col("__e")).otherwise(0), "choch": F.when(F.col("__e").isNotNull() & ~same, F.col("__e")).otherwise(0)}).drop("__ph", "__pl", "__e", "__r")


def regime(df: DataFrame, width_window: int = 20, slope_window: int = 12, atr: str = "atr") -> DataFrame:
    """Interquartile width and last range against ATR, and the slope of closes: ``regime_label`` names the largest that stands out."""
    out = rolling_quantiles(linreg_slope(df, "close", slope_window, "__s"), "close", width_window, {"__q1": 0.25, "__q3": 0.75})
    out = out.withColumns({"width_atr": ratio(F.col("__q3") - F.col("__q1"), F.col(atr)), "spike_atr": ratio(F.col("high") - F.col("low"), F.col(atr)), "slope_atr": ratio(F.col("__s"), F.col(atr))}).drop("__s", "__q1", "__q3")
    label = F.when(F.col("spike_atr") >= 2.5, "spike").when(F.abs("slope_atr") >= 0.1, "trend").when(F.col("width_atr").isNotNull(), "range")
    return out.withColumn("regime_label", label)
