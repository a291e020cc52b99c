"""Indicators that are window expressions over one series; every function adds columns to a table of candles.

Windows are partitioned by (symbol, tf) and ordered by ts. Null stands for "no value yet"; NaN is never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.sources.candles import KEY, series

EPS = 1e-9


def frame(n: int):
    """The current row and the n - 1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(value: Column, c, n: int, least: int | None = None) -> Column:
    """value once the frame of n rows has ``least`` (n if not given) values."""
    return F.when(F.count(col(c)).over(frame(n)) >= (n if least in (None, -1) else least), value)


def mean(c, n: int, least: int | None = None) -> Column:
    return filled(F.avg(col(c)).over(frame(n)), c, n, least)


def highest(c, n: int, least: int | None = None) -> Column:
    return filled(F.max(col(c)).over(frame(n)), c, n, least)


def lowest(c, n: int, least: int | None = None) -> Column:
    return filled(F.min(col(c)).over(frame(n)), c, n, least)


def prev(c, k: int = 1) -> Column:
    return F.lag(col(c), k).over(series())


def total(c, n: int, least: int | None = None) -> Column:
    return filled(F.sum(col(c)).over(frame(n)), c, n, least)


def linear_weighted(c, n: int, least: int | None = None) -> Column:
    """Weights 1 .. n, the newest heaviest; a frame not yet full uses the heaviest ones alone, renormalised."""
    rows = F.collect_list(col(c)).over(frame(n))
    weights = F.transform(rows, lambda _, i: (n - F.size(rows) + 1 + i).cast("double"))
    top = F.aggregate(F.zip_with(rows, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return filled(top / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), c, n, least)


def sma(df: DataFrame, column: str = "close", period: int = 20, min_periods: int = -1, out: str = "sma") -> DataFrame:
    return df.withColumn(out, mean(column, period, min_periods))


def wma(df: DataFrame, column: str = "close", period: int = 20, min_periods: int = -1, out: str = "wma") -> DataFrame:
    return df.withColumn(out, linear_weighted(column, period, min_periods))


def roc(df: DataFrame, column: str = "close", period: int = 10, out: str = "roc") -> DataFrame:
    return df.withColumn(out, ratio(F.col(column) - prev(column, period), prev(column, period)) * 100)


def true_range_of() -> Column:
    """The first row has no previous close and takes high - low."""
    before = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def truerange(df: DataFrame, out: str = "true_range") -> DataFrame:
    return df.withColumn(out, true_range_of())


def atr_classic(df: DataFrame, period: int = 14, min_periods: int = -1, out: str = "atr") -> DataFrame:
    return df.withColumn("__tr", true_range_of()).withColumn(out, mean("__tr", period, min_periods)).drop("__tr")


def bollinger(df: DataFrame, column: str = "close", period: int = 20, multiplier: float = 2.0, min_periods: int = -1) -> DataFrame:
    """bb_upper, bb_middle, bb_lower, bb_width, bb_percent, with the population deviation."""
    mid, dev = mean(column, period, min_periods), filled(F.stddev_pop(column).over(frame(period)), column, period, min_periods)
    out = df.withColumns({"bb_middle": mid, "__dev": dev})
    out = out.withColumns({"bb_upper": F.col("bb_middle") + multiplier * F.col("__dev"), "bb_lower": F.col("bb_middle") - multiplier * F.col("__dev")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"bb_width": width, "bb_percent": ratio(F.col(column) - F.col("bb_lower"), width)}).drop("__dev")


def stochastic(df: DataFrame, k_period: int = 14, d_period: int = 3, smooth_k: int = 3) -> DataFrame:
    """stoch_k, stoch_d by simple means; a range of 0 gives 0."""
    hh, ll = highest("high", k_period), lowest("low", k_period)
    raw = F.when(hh == ll, 0.0).otherwise(100 * (F.col("close") - ll) / (hh - ll))
    out = df.withColumn("__raw", F.when(hh.isNotNull(), raw))
    out = out.withColumn("stoch_k", F.when(F.col("__raw").isNotNull(), mean("__raw", smooth_k, 1)))
    return out.withColumn("stoch_d", F.when(F.col("stoch_k").isNotNull(), mean("stoch_k", d_period, 1))).drop("__raw")


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def cci(df: DataFrame, period: int = 20, min_periods: int = -1, out: str = "cci") -> DataFrame:
    """Mean absolute deviation around the current mean."""
    rows = F.collect_list("__tp").over(frame(period))
    step = df.withColumn("__tp", typical()).withColumns({"__m": mean("__tp", period, min_periods), "__rows": rows})
    dev = F.aggregate("__rows", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("__m"))) / F.size("__rows")
    return step.withColumn(out, (F.col("__tp") - F.col("__m")) / (0.015 * dev + EPS)).drop("__tp", "__m", "__rows")


def mfi(df: DataFrame, period: int = 14, out: str = "mfi") -> DataFrame:
    """Money flow: share of the flow on rising bars; 50 where there is none."""
    step = df.withColumn("__tp", typical())
    before = prev("__tp")
    flow = F.col("__tp") * F.col("volume")
    step = step.withColumns({"__up": F.when(before.isNotNull(), F.when(F.col("__tp") > before, flow).otherwise(0.0)), "__down": F.when(before.isNotNull(), F.when(F.col("__tp") < before, flow).otherwise(0.0))})
    up, down = total("__up", period), total("__down", period)
    return step.withColumn(out, F.when(up + down == 0, 50.0).otherwise(100 * up / (up + down))).drop("__tp", "__up", "__down")


def obv(df: DataFrame, out: str = "obv") -> DataFrame:
    step = df.withColumn("__s", F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)) * F.col("volume"))
    return step.withColumn(out, F.sum("__s").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def williamsr(df: DataFrame, period: int = 14, min_periods: int = -1, out: str = "williamsr") -> DataFrame:
    hh, ll = highest("high", period, min_periods), lowest("low", period, min_periods)
    return df.withColumn(out, F.when(hh - ll >= EPS, -100 * (hh - F.col("close")) / (hh - ll)))


def aroon(df: DataFrame, period: int = 25) -> DataFrame:
    """aroon_up, aroon_down, aroon_osc; of equal extremes the latest counts."""

    def since(c: str, pick) -> Column:
        rows = F.reverse(F.collect_list(c).over(frame(period)))
        return filled((period - (F.array_position(rows, pick(rows)) - 1)) / F.lit(float(period)) * 100, c, period)

    out = df.withColumns({"aroon_up": since("high", F.array_max), "aroon_down": since("low", F.array_min)})
    return out.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def hma(df: DataFrame, column: str = "close", period: int = 20, out: str = "hma") -> DataFrame:
    """WMA over sqrt(n) of twice the half-length WMA minus the full one."""
    step = df.withColumn("__d", 2 * linear_weighted(column, max(1, period // 2), 1) - linear_weighted(column, period, 1))
    return step.withColumn(out, F.when(F.count(column).over(frame(period)) >= period, linear_weighted("__d", max(1, int(period**0.5)), 1))).drop("__d")


# -- further indicators -------------------------------------------------------


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.withColumns({"dc_upper": highest("high", n), "dc_lower": lowest("low", n)})
    width = F.col("dc_upper") - F.col("dc_lower")
    out = out.withColumns({"dc_mid": (F.col("dc_upper") + F.col("dc_lower")) / 2, "dc_width": width, "dc_pos": ratio(F.col("close") - F.col("dc_lower"), width)})
    return out.withColumns({"dc_break_up": F.coalesce((F.col("close") > prev("dc_upper")).cast("int"), F.lit(0)), "dc_break_down": F.coalesce((F.col("close") < prev("dc_lower")).cast("int"), F.lit(0))})


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, span_b: int = 52) -> DataFrame:
    mid = lambda n: (highest("high", n) + lowest("low", n)) / 2
    out = df.withColumns({"tenkan": mid(tenkan), "kijun": mid(kijun), "__b": mid(span_b)})
    return out.withColumns({"span_a": prev((F.col("tenkan") + F.col("kijun")) / 2, kijun), "span_b": prev("__b", kijun)}).drop("__b")


def zscore(df: DataFrame, column: str = "close", window: int = 20, out: str = "zscore") -> DataFrame:
    dev = F.stddev_samp(column).over(frame(window))
    return df.withColumn(out, filled(ratio(F.col(column) - F.avg(column).over(frame(window)), dev), column, window))


def linreg_slope(df: DataFrame, column: str = "close", window: int = 14, out: str = "slope") -> DataFrame:
    """Slope of the least-squares line over the row number."""
    step = df.withColumn("__x", F.row_number().over(series()).cast("double"))
    slope = F.regr_slope(F.col(column), F.col("__x")).over(frame(window))
    return step.withColumn(out, filled(slope, column, window)).drop("__x")


def ma_slope(df: DataFrame, column: str = "close", window: int = 20, step: int = 3, out: str = "ma_slope") -> DataFrame:
    """Change of the mean over ``step`` rows for each row, as a share of price."""
    base = df.withColumn("__ma", mean(column, window))
    return base.withColumn(out, ratio((F.col("__ma") - prev("__ma", step)) / step, F.col(column))).drop("__ma")


def ma_slope_regression(df: DataFrame, column: str = "close", window: int = 20, fit: int = 10, norm: str | None = "atr", out: str = "ma_reg_slope") -> DataFrame:
    """Least-squares slope of the moving average over ``fit`` bars, divided by the column ``norm`` if there is one."""
    made = linreg_slope(sma(df, column, window, out="__ma"), "__ma", fit, "__slope")
    return made.withColumn(out, F.col("__slope") if norm is None else ratio(F.col("__slope"), F.col(norm))).drop("__ma", "__slope")


def band_position(df: DataFrame, lower: str, upper: str, column: str = "close", out: str = "position") -> DataFrame:
    """Where the column stands between two bands: 0 at the lower, 1 at the upper, null where they meet."""
    return df.withColumn(out, ratio(F.col(column) - F.col(lower), F.col(upper) - F.col(lower)))


def oscillator_zones(df: DataFrame, column: str = "rsi", high: float = 70.0, low: float = 30.0, middle: float = 50.0, band: float = 5.0) -> DataFrame:
    """overbought, oversold and mid flags (0/1) of an oscillator; null is none of them."""
    c = F.col(column)
    tests = {"overbought": c >= high, "oversold": c <= low, "mid": F.abs(c - middle) <= band}
    return df.withColumns({f"{column}_{n}": F.coalesce(t.cast("int"), F.lit(0)) for n, t in tests.items()})


def vwap_daily(df: DataFrame, out: str = "vwap") -> DataFrame:
    day = Window.partitionBy(*KEY, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, ratio(F.sum(typical() * F.col("volume")).over(day), F.sum("volume").over(day).cast("double")))


def vwap_rolling(df: DataFrame, n: int = 100, out: str = "vwap_n") -> DataFrame:
    return df.withColumn(out, ratio(total(typical() * F.col("volume"), n), total("volume", n).cast("double")))


def money_flow() -> Column:
    span = F.col("high") - F.col("low")
    return F.coalesce(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span), F.lit(0.0)) * F.col("volume")


def adl(df: DataFrame, out: str = "adl") -> DataFrame:
    return df.withColumn(out, F.sum(money_flow()).over(series().rowsBetween(Window.unboundedPreceding, 0)))


def cmf(df: DataFrame, n: int = 20, out: str = "cmf") -> DataFrame:
    return df.withColumn(out, ratio(total(money_flow(), n), total("volume", n).cast("double")))


def pivots(df: DataFrame, column: str = "close", k: int = 2, out: str = "pivot") -> DataFrame:
    """1 where the row k back was the highest of 2k + 1, -1 where the lowest, known only now; of equal ones the latest counts."""
    span = 2 * k + 1
    full = F.count(column).over(frame(span)) == span
    rows = F.reverse(F.collect_list(column).over(frame(span)))
    at = lambda pick: full & (F.array_position(rows, pick(rows)) == k + 1)
    return df.withColumn(out, F.when(at(F.array_max), 1).when(at(F.array_min), -1).otherwise(0))


def pivots_classic(df: DataFrame) -> DataFrame:
    """Pivot point, three resistances and supports of the bar before."""
    h, lo, c = prev("high"), prev("low"), prev("close")
    p = (h + lo + c) / 3
    return df.withColumns({"pp": p, "r1": 2 * p - lo, "s1": 2 * p - h, "r2": p + (h - lo), "s2": p - (h - lo), "r3": h + 2 * (p - lo), "s3": lo - 2 * (h - p)})


def adr(df: DataFrame, window: int = 14) -> DataFrame:
    """adr: mean range of the ``window`` days before (half of them at least); day_open, its distance from close, and that in % of adr."""
    days = df.groupBy(*KEY, F.to_date("ts").alias("day")).agg((F.max("high") - F.min("low")).alias("range"), F.min_by("close", "ts").alias("day_open"))
    before = Window.partitionBy(*KEY).orderBy("day").rowsBetween(-window, -1)
    least = max(2, window // 2)
    days = days.withColumn("adr", F.when(F.count("range").over(before) >= least, F.avg("range").over(before))).drop("range")
    out = df.withColumn("day", F.to_date("ts")).join(days, [*KEY, "day"]).drop("day")
    dist = F.abs(F.col("close") - F.col("day_open"))
    return out.withColumns({"adr_dist": dist, "adr_dist_pct": ratio(dist, F.col("adr")) * 100})


def round_level_distance(df: DataFrame, anchor: float, step: float, n: int = 10) -> DataFrame:
    """The nearest of the round prices anchor +- k * step (k up to n), and the distance from it."""
    base = F.floor(F.lit(anchor) / step) * step
    k = F.greatest(F.lit(-n), F.least(F.lit(n), F.floor((F.col("close") - base) / step + 0.5)))
    out = df.withColumn("round_level", F.when(F.col("close").isNotNull(), (base + k * step).cast("double")))
    return out.withColumns({"round_signed": F.col("close") - F.col("round_level"), "round_abs": F.abs(F.col("close") - F.col("round_level"))})


def relative(df: DataFrame, window: int = 20) -> DataFrame:
    """Prices relative to the close before, and volume relative to the mean of the ``window`` rows before (one at least)."""
    before = F.nullif(prev("close"), F.lit(0.0))
    past = F.avg("volume").over(series().rowsBetween(-window, -1))
    return df.withColumns({f"{c}_rel": F.col(c) / before - 1 for c in ("open", "high", "low", "close")} | {"volume_rel": ratio(F.col("volume").cast("double"), past)})


def divergence(df: DataFrame, price: str = "close", osc: str = "rsi", k: int = 2) -> DataFrame:
    """div_bear, div_bull: at a confirmed price pivot, price and oscillator moved apart since the last pivot of its kind."""
    out = pivots(df, price, k, "__p")
    past = series().rowsBetween(Window.unboundedPreceding, -1)

    def flag(kind: int, up: bool) -> Column:
        last_p = F.last(F.when(F.col("__p") == kind, F.col(price)), True).over(past)
        last_o = F.last(F.when(F.col("__p") == kind, F.col(osc)), True).over(past)
        apart = (F.col(price) > last_p) & (F.col(osc) < last_o) if up else (F.col(price) < last_p) & (F.col(osc) > last_o)
        return F.when((F.col("__p") == kind) & apart, 1).otherwise(0)

    return out.withColumns({"div_bear": flag(1, True), "div_bull": flag(-1, False)}).drop("__p")


def divergence_values(df: DataFrame, price: str = "close", osc: str = "rsi", k: int = 2, hidden: bool = False) -> DataFrame:
    """div_bear_value, div_bull_value: at a confirmed price pivot where price and oscillator moved apart since the last pivot of
    its kind, by how much the oscillator moved; null elsewhere. ``hidden`` asks for the opposite directions."""
    out = pivots(df, price, k, "__p")
    past = series().rowsBetween(Window.unboundedPreceding, -1)

    def value(kind: int) -> Column:
        last_p, last_o = (F.last(F.when(F.col("__p") == kind, F.col(c)), True).over(past) for c in (price, osc))
        further = kind if not hidden else -kind
        apart = (F.signum(F.col(price) - last_p) == further) & (F.signum(F.col(osc) - last_o) == -further)
        return F.when((F.col("__p") == kind) & apart, F.col(osc) - last_o)

    return out.withColumns({"div_bear_value": value(1), "div_bull_value": value(-1)}).drop("__p")


def zscore_distance(value: Column, mean_: Column, deviation: Column, eps: float = 1e-12) -> Column:
    """How many deviations a value is from the mean."""
    return (value - mean_) / (F.abs(deviation) + eps)
