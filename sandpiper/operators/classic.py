"""The older definitions of some indicators, where they differ from the default ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators.recursive import ordered_fold, recur, seeded, smooth
from sandpiper.operators.rolling import col, frame, highest, lowest, mean, prev, ratio, total, true_range_of, typical
from sandpiper.sources.candles import series


def ema(df: DataFrame, column: str = "close", period: int = 20, out: str = "classic_ema") -> DataFrame:
    """Seeded with the plain mean of the first ``period`` values."""
    return recur(df, **{out: seeded(column, period, 2 / (period + 1))})


def rsi(df: DataFrame, column: str = "close", period: int = 14, method: str = "ema", out: str = "classic_rsi") -> DataFrame:
    """Means of gains and losses that start with the first change; the first ``period`` rows are null, and so is a loss of 0."""
    alpha = {"ema": 2 / (period + 1), "wilders": 1 / period}[method]
    change = F.coalesce(F.col(column) - prev(column), F.lit(0.0))
    step = df.withColumns({"__g": F.greatest(change, F.lit(0.0)), "__l": F.greatest(-change, F.lit(0.0))})
    step = recur(step, __ag=smooth("__g", alpha), __al=smooth("__l", alpha))
    rows = F.row_number().over(series())
    return step.withColumn(out, F.when(rows > period, 100 - 100 / (1 + ratio(F.col("__ag"), F.col("__al"))))).drop("__g", "__l", "__ag", "__al")


def macd(df: DataFrame, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """classic_macd from row slow + 1 on; the signal from row slow + signal - 1 on, smoothed from the first row."""
    out = recur(df, __f=smooth(column, 2 / (fast + 1)), __s=smooth(column, 2 / (slow + 1))).withColumn("__m", F.col("__f") - F.col("__s"))
    out = recur(out, __g=smooth("__m", 2 / (signal + 1)))
    rows = F.row_number().over(series())
    out = out.withColumns({"classic_macd": F.when(rows > slow, F.col("__m")), "classic_macd_signal": F.when(rows >= slow + signal - 1, F.col("__g"))})
    return out.withColumn("classic_macd_hist", F.col("classic_macd") - F.col("classic_macd_signal")).drop("__f", "__s", "__m", "__g")


def cci(df: DataFrame, period: int = 20, out: str = "classic_cci") -> DataFrame:
    """Mean of each row's own distance from its own mean."""
    step = df.withColumn("__tp", typical()).withColumn("__m", mean("__tp", period)).withColumn("__d", F.abs(F.col("__tp") - F.col("__m")))
    return step.withColumn(out, ratio(F.col("__tp") - F.col("__m"), 0.015 * mean("__d", period))).drop("__tp", "__m", "__d")


def mfi(df: DataFrame, period: int = 14, out: str = "classic_mfi") -> DataFrame:
    """Null where no flow fell."""
    step = df.withColumn("__tp", typical())
    flow = F.col("__tp") * F.col("volume")
    step = step.withColumns({"__u": F.when(F.col("__tp") > prev("__tp"), flow).otherwise(0.0), "__d": F.when(F.col("__tp") < prev("__tp"), flow).otherwise(0.0)})
    return step.withColumn(out, 100 - 100 / (1 + ratio(total("__u", period), total("__d", period)))).drop("__tp", "__u", "__d")


def obv(df: DataFrame, out: str = "classic_obv") -> DataFrame:
    """The first row is null."""
    step = df.withColumn("__s", F.signum(F.col("close") - prev("close")) * F.col("volume"))
    return step.withColumn(out, F.sum("__s").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def stochastic(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    """%K not smoothed, null at a range of 0."""
    hh, ll = highest("high", n), lowest("low", n)
    out = df.withColumn("classic_k", 100 * ratio(F.col("close") - ll, hh - ll))
    return out.withColumn("classic_d", mean("classic_k", d))


def aroon(df: DataFrame, n: int = 25) -> DataFrame:
    """Divided by n - 1."""

    def since(c, pick):
        rows = F.reverse(F.collect_list(c).over(frame(n)))
        return F.when(F.size(rows) == n, (n - 1 - (F.array_position(rows, pick(rows)) - 1)) / F.lit(float(n - 1)) * 100)

    return df.withColumns({"classic_aroon_up": since("high", F.array_max), "classic_aroon_down": since("low", F.array_min)})


def wma(df: DataFrame, column: str = "close", period: int = 20, out: str = "classic_wma") -> DataFrame:
    """Linear weights, the newest ``period``, over full windows; a missing value counts as 0."""
    return df.withColumn(out, zero_filled(column, period))


def zero_filled(c, n: int):
    rows = F.collect_list(F.coalesce(col(c), F.lit(0.0))).over(frame(n))
    weighed = F.aggregate(F.transform(rows, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.count("*").over(frame(n)) == n, weighed / (n * (n + 1) / 2))


def hma(df: DataFrame, column: str = "close", period: int = 20, out: str = "classic_hma") -> DataFrame:
    """The weighted mean over sqrt(period) of twice that over half the period less that over all; where these are missing they count as 0."""
    step = df.withColumn("__x", 2 * zero_filled(column, max(1, period // 2)) - zero_filled(column, period))
    return step.withColumn(out, zero_filled("__x", max(1, int(period**0.5)))).drop("__x")


def dema(df: DataFrame, column: str = "close", period: int = 20, out: str = "classic_dema") -> DataFrame:
    """Twice the seeded mean less that mean's own, each seeded with the plain mean of its first ``period`` values."""
    alpha = 2 / (period + 1)
    step = recur(df, __1=seeded(column, period, alpha))
    step = recur(step, __2=seeded("__1", period, alpha))
    return step.withColumn(out, 2 * F.col("__1") - F.col("__2")).drop("__1", "__2")


def tema(df: DataFrame, column: str = "close", period: int = 20, out: str = "classic_tema") -> DataFrame:
    """Three times the difference of the first two such means, plus the third."""
    alpha = 2 / (period + 1)
    step = recur(df, __1=seeded(column, period, alpha))
    step = recur(step, __2=seeded("__1", period, alpha))
    step = recur(step, __3=seeded("__2", period, alpha))
    return step.withColumn(out, 3 * F.col("__1") - 3 * F.col("__2") + F.col("__3")).drop("__1", "__2", "__3")


def keltner(df: DataFrame, period: int = 20, times: float = 2.0) -> DataFrame:
    """classic_kc_middle, _upper, _lower: the seeded mean of closes, and the plain mean of the true range around it."""
    step = recur(df.withColumn("__tr", true_range_of()), classic_kc_middle=seeded("close", period, 2 / (period + 1)))
    step = step.withColumn("__a", mean("__tr", period))
    return step.withColumns({"classic_kc_upper": F.col("classic_kc_middle") + times * F.col("__a"), "classic_kc_lower": F.col("classic_kc_middle") - times * F.col("__a")}).drop("__tr", "__a")


def kama(df: DataFrame, column: str = "close", period: int = 10, fast: int = 2, slow: int = 30, out: str = "classic_kama") -> DataFrame:
    """Efficiency over ``period`` changes; the first ``period`` rows are the price itself, and without an efficiency the last value stays."""
    quick, slower = 2 / (fast + 1), 2 / (slow + 1)
    step = df.withColumn("__d", F.abs(F.col(column) - prev(column)))
    er = ratio(F.abs(F.col(column) - prev(column, period)), total("__d", period))
    step = step.withColumns({"__sc": F.pow(er * (quick - slower) + slower, 2), "__n": F.row_number().over(series())})
    early = F.col("__n") <= period
    a = F.when(early, 0.0).otherwise(1 - F.coalesce("__sc", F.lit(0.0)))
    b = F.when(early, F.col(column)).otherwise(F.coalesce(F.col("__sc") * F.col(column), F.lit(0.0)))
    return recur(step, **{out: (a, b)}).drop("__d", "__sc", "__n")


def adxr(df: DataFrame, adx: str = "adx", period: int = 14, out: str = "adxr") -> DataFrame:
    """Half the ADX and half that of ``period`` bars before."""
    return df.withColumn(out, 0.5 * (F.col(adx) + prev(adx, period)))


def parabolic_sar(df: DataFrame, af_start: float = 0.02, af_step: float = 0.02, af_max: float = 0.2, out: str = "classic_psar") -> DataFrame:
    """The first two bars set the direction and have no stop; a stop never enters the range of the two bars before."""

    def step(rows):
        past: list[tuple[float, float]] = []
        way = stop = extreme = rate = None
        for high, low in rows:
            if len(past) < 2:
                past.append((high, low))
                if len(past) == 2:
                    (high0, low0), (high1, low1) = past
                    way = 1 if high1 > high0 else -1
                    stop, extreme, rate = (low0, high1, af_start) if way == 1 else (high0, low1, af_start)
                yield (None,)
                continue
            stop += rate * (extreme - stop)
            stop = min(stop, past[0][1], past[1][1]) if way == 1 else max(stop, past[0][0], past[1][0])
            if (low < stop) if way == 1 else (high > stop):
                way, stop, rate = -way, extreme, af_start
                extreme = low if way == -1 else high
            elif (high > extreme) if way == 1 else (low < extreme):
                extreme, rate = (high if way == 1 else low), min(rate + af_step, af_max)
            past = [past[1], (high, low)]
            yield (stop,)

    return ordered_fold(df, ["high", "low"], [out], step)


def supertrend(df: DataFrame, period: int = 10, times: float = 3.0) -> DataFrame:
    """classic_st, one line that starts at the upper band, and classic_st_dir: 1 while the close is above it."""
    step_in = df.withColumn("__tr", true_range_of()).withColumn("__a", mean("__tr", period))
    step_in = step_in.withColumns({"__top": (F.col("high") + F.col("low")) / 2 + times * F.col("__a"), "__bottom": (F.col("high") + F.col("low")) / 2 - times * F.col("__a")})

    def step(rows):
        line = None
        for close, top, bottom in rows:
            if top is None:
                yield None, None
                continue
            if line is None:
                line = top
            else:
                line = max(line, bottom) if close > line else min(line, top)
            yield line, 1.0 if close > line else -1.0

    return ordered_fold(step_in, ["close", "__top", "__bottom"], ["classic_st", "classic_st_dir"], step).drop("__tr", "__a", "__top", "__bottom")

