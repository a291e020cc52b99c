"""Indicators whose value depends on the one before.

Most are linear recurrences y = a * y_before + b with a and b from window expressions; as such steps compose, one helper runs any
number of them over a series by doubling, on whole arrays. Three state machines (SAR, Supertrend, zigzag) have a step of
their own. Rows reach Python as Arrow tables, of which only the columns that are read are unpacked.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sandpiper.operators.rolling import col, prev, ratio, true_range_of
from sandpiper.session import ship
from sandpiper.sources.candles import KEY, series


def by_series(df: DataFrame, outs: list[str], make: Callable[[pa.Table], list], by: tuple[str, ...] = KEY, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Append ``outs`` to every series: make takes its rows in order and gives an array for each."""
    ship(df.sparkSession)
    fields = [f for f in df.schema if f.name not in outs]
    names = [f.name for f in fields]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        return pa.Table.from_arrays([*(rows.column(c) for c in names), *(pa.array(x, pa.float64(), from_pandas=True) for x in make(rows))], names=[*names, *outs])

    return df.groupBy(*by).applyInArrow(run, StructType([*fields, *(StructField(o, DoubleType()) for o in outs)]))


def ordered_fold(df: DataFrame, reads: list[str], outs: list[str], step: Callable[[Iterator[tuple]], Iterator[tuple]], by: tuple[str, ...] = KEY, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Append ``outs`` to every series: step takes the rows of ``reads`` in time order and yields a tuple for each."""

    def values(column: pa.ChunkedArray) -> list:
        return (pc.if_else(pc.is_nan(column), None, column) if pa.types.is_floating(column.type) else column).to_pylist()

    def make(rows: pa.Table) -> list:
        return list(zip(*step(zip(*(values(rows.column(c)) for c in reads), strict=True)), strict=True))

    return by_series(df, outs, make, by, order)


def scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y = a * y_before + b over a series; NaN in b gives NaN and keeps the state, the first other b is the seed.

    Steps y -> a * y + b compose to such a step, so runs of 1, 2, 4, ... rows are joined until the steps before no longer count.
    """
    have = np.flatnonzero(~np.isnan(b))
    if not len(have):
        return b.copy()
    factor, y = a[have].astype(float), b[have].astype(float)
    factor[0] = 0.0
    far = 1
    while far < len(y) and factor[far:].any():
        y[far:] = y[far:] + factor[far:] * y[:-far]
        factor[far:] = factor[far:] * factor[:-far]
        far *= 2
    out = np.full(len(b), np.nan)
    out[have] = y
    return out


def smoothed(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean with the first value as its seed."""
    b, first = alpha * x, np.flatnonzero(~np.isnan(x))[:1]
    b[first] = x[first]
    return scan(np.full(len(x), 1 - alpha), b)


def doubles(rows: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return rows.column(name).cast(pa.float64()).to_numpy()


def recur(df: DataFrame, **terms: tuple[Column, Column]) -> DataFrame:
    """For each name=(a, b) the column y = a * y_before + b; null b gives null and keeps the state; the first b is the seed."""
    step_in = df.withColumns({f"__{side}_{n}": c for n, ab in terms.items() for side, c in zip("ab", ab, strict=True)})
    names = list(terms)
    made = by_series(step_in, names, lambda rows: [scan(doubles(rows, f"__a_{n}"), doubles(rows, f"__b_{n}")) for n in names])
    return made.drop(*(f"__{side}_{n}" for n in terms for side in "ab"))


def number() -> Column:
    return F.row_number().over(series())


def smooth(c, alpha: float) -> tuple[Column, Column]:
    """Exponential mean with the first value as its seed."""
    first = F.first(F.when(col(c).isNotNull(), F.col("ts")), True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return F.lit(1 - alpha), F.when(F.col("ts") == first, col(c)).otherwise(alpha * col(c))


def seeded(c, n: int, alpha: float) -> tuple[Column, Column]:
    """Exponential mean whose seed is the plain mean of the first n values."""
    k = F.count(col(c)).over(series())
    return F.lit(1 - alpha), F.when(k == n, F.avg(col(c)).over(series().rowsBetween(-(n - 1), 0))).when(k > n, alpha * col(c))


def after(c: str, n: int, least: int = -1, count: str = "close") -> Column:
    return F.when(F.count(count).over(series()) >= (n if least == -1 else least), F.col(c))


#: What each mean adds up from the exponential mean, its own mean, and the mean of that.
MEANS = {"ema": (1.0, 0.0, 0.0), "dema": (2.0, -1.0, 0.0), "tema": (3.0, -3.0, 1.0)}


def means(df: DataFrame, names: dict[str, str], column: str = "close", period: int = 20, min_periods: int = -1) -> DataFrame:
    """For each output the mean named for it (ema, dema or tema), all in one pass."""

    def make(rows: pa.Table) -> list:
        levels = [doubles(rows, column)]
        for _ in range(max(sum(w != 0 for w in MEANS[m]) for m in names.values())):
            levels.append(smoothed(levels[-1], 2 / (period + 1)))
        return [sum(w * x for w, x in zip(MEANS[m], levels[1:], strict=False) if w) for m in names.values()]

    made = by_series(df, list(names), make)
    return made.withColumns({out: after(out, period, min_periods, column) for out in names})


def ema(df: DataFrame, column: str = "close", period: int = 20, min_periods: int = -1, out: str = "ema") -> DataFrame:
    return means(df, {out: "ema"}, column, period, min_periods)


def macd(df: DataFrame, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal, macd_hist; the signal starts on the first valid macd."""

    def make(rows: pa.Table) -> list:
        x = doubles(rows, column)
        line = smoothed(x, 2 / (fast + 1)) - smoothed(x, 2 / (slow + 1))
        line[np.cumsum(~np.isnan(x)) < slow] = np.nan
        own = smoothed(line, 2 / (signal + 1))
        own[np.cumsum(~np.isnan(line)) < signal] = np.nan
        return [line, own]

    return by_series(df, ["macd", "macd_signal"], make).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, column: str = "close", period: int = 14, method: str = "ema", out: str = "rsi") -> DataFrame:
    """Means of gains and losses, seeded with the first ``period`` of them; no loss gives 100, no move 50."""
    alpha = {"ema": 2 / (period + 1), "wilders": 1 / period}[method]
    change = F.col(column) - prev(column)
    step = df.withColumns({"__g": F.greatest(change, change * 0), "__l": F.greatest(-change, change * 0)})
    step = recur(step, __ag=seeded("__g", period, alpha), __al=seeded("__l", period, alpha))
    value = F.when(F.col("__al") == 0, F.when(F.col("__ag") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.col("__ag") / F.col("__al")))
    return step.withColumn(out, value).drop("__g", "__l", "__ag", "__al")


def atr(df: DataFrame, period: int = 14, method: str = "wilder", out: str = "atr") -> DataFrame:
    alpha = {"wilder": 1 / period, "ema": 2 / (period + 1)}[method]
    return recur(df.withColumn("__tr", true_range_of()), **{out: seeded("__tr", period, alpha)}).drop("__tr")


def keltner(df: DataFrame, period: int = 20, multiplier: float = 2.0) -> DataFrame:
    """kc_middle (EMA), kc_upper and kc_lower by Wilder's ATR, kc_width, kc_percent."""
    out = recur(df.withColumn("__tr", true_range_of()), kc_middle=smooth("close", 2 / (period + 1)), __atr=seeded("__tr", period, 1 / period))
    out = out.withColumn("kc_middle", after("kc_middle", period))
    out = out.withColumns({"kc_upper": F.col("kc_middle") + multiplier * F.col("__atr"), "kc_lower": F.col("kc_middle") - multiplier * F.col("__atr")})
    width = F.col("kc_upper") - F.col("kc_lower")
    return out.withColumns({"kc_width": width, "kc_percent": ratio(F.col("close") - F.col("kc_lower"), width)}).drop("__tr", "__atr")


def dema(df: DataFrame, column: str = "close", period: int = 20, min_periods: int = -1) -> DataFrame:
    return means(df, {"dema": "dema"}, column, period, min_periods)


def tema(df: DataFrame, column: str = "close", period: int = 20, min_periods: int = -1) -> DataFrame:
    return means(df, {"tema": "tema"}, column, period, min_periods)


def kama(df: DataFrame, column: str = "close", period: int = 10, fast_span: int = 2, slow_span: int = 30, out: str = "kama") -> DataFrame:
    """Efficiency over the last ``period`` rows sets the smoothing; the seed is the price of the first full window."""
    quick, slow = 2 / (fast_span + 1), 2 / (slow_span + 1)
    step = df.withColumn("__d", F.abs(F.col(column) - prev(column)))
    path = F.sum("__d").over(series().rowsBetween(-(period - 2), 0))
    er = F.when(path < 1e-9, 0.0).otherwise(F.abs(F.col(column) - prev(column, period - 1)) / path)
    step = step.withColumns({"__sc": F.pow(er * (quick - slow) + slow, 2), "__k": F.count(column).over(series())})
    b = F.when(F.col("__k") == period, F.col(column)).when(F.col("__k") > period, F.col("__sc") * F.col(column))
    return recur(step, **{out: (1 - F.col("__sc"), b)}).drop("__d", "__sc", "__k")


def heikin_ashi(df: DataFrame) -> DataFrame:
    """ha_open is half the last ha_open and half the last ha_close; the first is the middle of open and close."""
    out = df.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    b = F.coalesce(prev("ha_close") / 2, (F.col("open") + F.col("close")) / 2)
    out = recur(out, ha_open=(F.lit(0.5), b))
    return out.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})


def adx(df: DataFrame, period: int = 14) -> DataFrame:
    """plus_di, minus_di, adx by Wilder's means, from the second row on."""
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    step = df.withColumns({"__p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "__m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)), "__t": F.when(up.isNotNull(), true_range_of())})
    step = recur(step, __sp=seeded("__p", period, 1 / period), __sm=seeded("__m", period, 1 / period), __st=seeded("__t", period, 1 / period))
    step = step.withColumns({"plus_di": 100 * ratio(F.col("__sp"), F.col("__st")), "minus_di": 100 * ratio(F.col("__sm"), F.col("__st"))})
    step = step.withColumn("__dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return recur(step, adx=seeded("__dx", period, 1 / period)).drop("__p", "__m", "__t", "__sp", "__sm", "__st", "__dx")


def chaikin_volatility(df: DataFrame, n: int = 10, change: int = 10, out: str = "chaikin_vol") -> DataFrame:
    step = recur(df.withColumn("__r", F.col("high") - F.col("low")), __e=smooth("__r", 2 / (n + 1)))
    return step.withColumn(out, ratio(F.col("__e") - prev("__e", change), prev("__e", change)) * 100).drop("__r", "__e")


def parabolic_sar(df: DataFrame, af_start: float = 0.02, af_step: float = 0.02, af_max: float = 0.2, out: str = "psar") -> DataFrame:
    """Rising from the first row with its low as stop; a stop that is crossed turns the direction at the extreme reached."""

    def step(rows):
        sar = extreme = rate = None
        rising = True
        for high, low in rows:
            if sar is None:
                sar, extreme, rate = low, high, af_start
                yield (None,)
                continue
            sar += rate * (extreme - sar)
            if (high > extreme) if rising else (low < extreme):
                extreme, rate = (high if rising else low), min(rate + af_step, af_max)
            if low < sar if rising else high > sar:
                rising = not rising
                sar, extreme, rate = extreme, (high if rising else low), af_start
            yield (sar,)

    return ordered_fold(df, ["high", "low"], [out], step)


def supertrend(df: DataFrame, period: int = 10, multiplier: float = 3.0, release: str = "previous") -> DataFrame:
    """supertrend (the band that holds) and supertrend_dir (1 up, -1 down; 1 until the ATR has a value).

    release: which close lets go of a band: that of the bar before (``previous``, the usual definition), or the bar's own (``current``, an
    older one), with which a band steps aside on the very bar that closes beyond it, so the direction hardly ever turns.
    """

    def step(rows):
        upper = lower = last = None
        trend = 1
        for mid, close, width in rows:
            before, last = last, close
            if width is None:
                yield None, 1.0
                continue
            top, bottom = mid + multiplier * width, mid - multiplier * width
            fresh = upper is None
            # a band only moves towards price, unless price has closed beyond it
            judge = close if release == "current" else before
            upper = top if fresh or judge > upper else min(top, upper)
            lower = bottom if fresh or judge < lower else max(bottom, lower)
            if not fresh and (close <= lower if trend == 1 else close >= upper):
                trend = -trend
            yield (lower if trend == 1 else upper), float(trend)

    out = atr(df, period, "wilder", "__atr").withColumn("__mid", (F.col("high") + F.col("low")) / 2)
    return ordered_fold(out, ["__mid", "close", "__atr"], ["supertrend", "supertrend_dir"], step).drop("__mid", "__atr")


def zigzag(df: DataFrame, reversal: float = 0.05) -> DataFrame:
    """zz: 1 or -1 on the row where a swing high or low is confirmed, zz_price its price; a swing ends once price has moved
    ``reversal`` (a share) against it. Only confirmed swings are given, so no later row changes an earlier one."""

    def step(rows):
        high = low = None
        trend = 0
        for h, lo in rows:
            if high is None:
                high, low = h, lo
            found = (0.0, None)
            if trend >= 0:
                high = max(high, h)
            if trend <= 0:
                low = min(low, lo)
            if trend >= 0 and lo <= high * (1 - reversal):
                found, trend, low = (1.0, high), -1, lo
            elif trend <= 0 and h >= low * (1 + reversal):
                found, trend, high = (-1.0, low), 1, h
            yield found

    return ordered_fold(df, ["high", "low"], ["zz", "zz_price"], step)


def rolling_quantiles(df: DataFrame, column: str, n: int, outs: dict[str, float]) -> DataFrame:
    """For each name=p the p-quantile (linear between neighbours) of the values in the frame of n rows, null where it has none.

    The frame is kept in order: a value is put in its place and the one that leaves is taken out, so time grows with the rows and
    not with rows times width, as sorting each frame anew would.
    """

    def make(rows: pa.Table) -> list:
        x = doubles(rows, column)
        made = np.full((len(outs), len(x)), np.nan)
        shares, frame = list(outs.values()), []
        for i, value in enumerate(x.tolist()):
            if i >= n and (old := x[i - n]) == old:
                frame.pop(bisect_left(frame, old))
            if value == value:
                insort(frame, value)
            if frame:
                for k, p in enumerate(shares):
                    at = p * (len(frame) - 1)
                    low = int(at)
                    made[k, i] = frame[low] if at == low else frame[low] + (at - low) * (frame[low + 1] - frame[low])
        return list(made)

    return by_series(df, list(outs), make)
