"""Swings, trend and its breaks, gaps, liquidity pools, regimes and weighted signals, bar by bar.

Everything known from a bar depends on it and earlier ones only. Windows give most of it; three registers whose content
depends on their past (causal swings, open gaps, pools) are ordered folds over a series.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators.patterns import flag, run_length
from sandpiper.operators.recursive import atr, ordered_fold
from sandpiper.operators.rolling import mean, prev, ratio, true_range_of
from sandpiper.sources.candles import KEY, series


def _upto(end: int = 0):
    return series().rowsBetween(Window.unboundedPreceding, end)


def swings(df: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """swing_high, swing_low: the price of the bar ``right`` bars ago if no bar of the ``left`` before and ``right`` after it goes beyond."""
    n = left + right + 1
    whole = series().rowsBetween(-(n - 1), 0)
    full = F.count("*").over(whole) == n
    high, low = prev("high", right), prev("low", right)
    return df.withColumns({
        "swing_high": F.when(full & (high == F.max("high").over(whole)), high),
        "swing_low": F.when(full & (low == F.min("low").over(whole)), low),
    })


def swing_trend(df: DataFrame) -> DataFrame:
    """trend (1, -1, 0 before any) from swings(), and its breaks: trend_bos with, trend_choch against the break before (1 up, -1 down).

    A swing high above all earlier ones, or a swing low above the lowest so far, speaks for up; the mirror for down. A swing
    low says so after a swing high of the same bar. A break is a lower high that turns the trend down or a higher low that
    turns it up.
    """
    top, bottom = F.max("swing_high").over(_upto(-1)), F.min("swing_low").over(_upto(-1))
    by_high = F.when(F.col("swing_high") > top, 1).when(F.col("swing_high") < top, -1)
    by_low = F.when(F.col("swing_low") < bottom, -1).when(F.col("swing_low") > bottom, 1)
    out = df.withColumns({"__h": by_high, "__l": by_low})
    out = out.withColumn("__says", F.coalesce("__l", "__h"))
    out = out.withColumns({"__was": F.coalesce(F.last("__says", True).over(_upto(-1)), F.lit(0)), "trend": F.coalesce(F.last("__says", True).over(_upto()), F.lit(0))})
    between = F.coalesce("__h", "__was")
    out = out.withColumn("__break", F.when((F.col("__l") == 1) & (between != 1), 1).when((F.col("__h") == -1) & (F.col("__was") != -1), -1))
    out = out.withColumn("__last", F.last("__break", True).over(_upto(-1)))
    same = F.col("__last").isNull() | (F.col("__last") == F.col("__break"))
    own = F.coalesce("__break", F.lit(0))
    return out.withColumns({"trend_bos": F.when(same, own).otherwise(0), "trend_choch": F.when(same, 0).otherwise(own)}).drop("__h", "__l", "__says", "__was", "__break", "__last")


def advance(state: tuple | None, high: float, low: float, close: float, reversal: float = 0.01, least: int = 1, by_close: bool = False) -> tuple[tuple, tuple | None]:
    """One bar of the causal swing machine: (state, swing), swing being (kind, price, place) or None; the first bar is place 0.

    state: (place, seek, extreme, place of it, place of the last swing, first high, low, close). The machine seeks highs
    (seek 1) after a low and lows (-1) after a high. The extreme so far becomes a swing once price (the close, or the bar's other end)
    is ``reversal`` of it away and it lies ``least`` bars after the last swing. The confirming bar's other end is the first extreme of
    the next search. The second bar sets the direction; until one does, each is held against the first.
    """
    if state is None:
        return (0, 0, 0.0, 0, 0, high, low, close), None
    place, seek, extreme, at, last, high0, low0, close0 = state
    place += 1
    ends = {1: high, -1: low}
    if not seek:
        way = 1 if high > high0 or close > close0 else -1 if low < low0 or close < close0 else 0
        if not way:
            return (place, *state[1:]), None
        start = {1: high0, -1: low0}
        here = way * ends[way] >= way * start[way]
        return (place, way, ends[way] if here else start[way], place if here else 0, 0, high0, low0, close0), (-way, start[-way], 0)
    if seek * ends[seek] >= seek * extreme:
        extreme, at = ends[seek], place
    away = seek * (extreme - (close if by_close else ends[-seek])) / max(abs(extreme), 1e-12)
    if away < reversal or at - last < least:
        return (place, seek, extreme, at, last, high0, low0, close0), None
    return (place, -seek, ends[-seek], place, at, high0, low0, close0), (seek, extreme, at)


def causal_swings(df: DataFrame, reversal: float = 0.01, least: int = 1, by_close: bool = False) -> DataFrame:
    """cs (1 high, -1 low) on the bar that confirms a swing, cs_price, and cs_age: how many bars ago it was (see advance())."""

    def step(rows):
        state = None
        for high, low, close in rows:
            state, found = advance(state, high, low, close, reversal, least, by_close)
            yield (0, None, None) if found is None else (found[0], found[1], state[0] - found[2])

    return ordered_fold(df, ["high", "low", "close"], ["cs", "cs_price", "cs_age"], step)


def volatility_threshold(df: DataFrame, period: int = 14, low: float = 1.2, normal: float = 2.0, high: float = 3.0) -> DataFrame:
    """vol_regime by ATR (seeded mean, then exponential) against the mean range of ``period`` bars, and vol_threshold, the ATR times the regime's factor."""
    out = atr(df, period, "ema", "__atr").withColumn("__tr", true_range_of())
    out = out.withColumn("__mean", mean("__tr", period))
    out = out.withColumn("vol_regime", F.when(F.col("__atr") < 0.8 * F.col("__mean"), "low").when(F.col("__atr") > 1.3 * F.col("__mean"), "high").otherwise("normal"))
    factor = F.when(F.col("vol_regime") == "low", low).when(F.col("vol_regime") == "high", high).otherwise(normal)
    return out.withColumn("vol_threshold", F.col("__atr") * factor).drop("__atr", "__tr", "__mean")


class Gaps:
    """Open gaps, which fill once the low reaches their bottom (bullish) or the high their top (bearish), or expire ``keep`` after their bar (never, if None).

    open: birth -> (kind, edge); a bar brings one gap at most. added and gone since the last clear(), for a store.
    """

    def __init__(self, keep=None, stored: dict | None = None) -> None:
        self.keep, self.open = keep, dict(sorted((stored or {}).items()))
        self.heaps: dict[int, list] = {1: [], -1: []}
        for born, (kind, edge) in self.open.items():
            self.heaps[kind].append((-kind * edge, born))
        for heap in self.heaps.values():
            heapq.heapify(heap)
        self.clear()

    def clear(self) -> None:
        self.added: dict = {}
        self.gone: set = set()

    def _drop(self, born) -> None:
        del self.open[born]
        if self.added.pop(born, None) is None:
            self.gone.add(born)

    def expire(self, now) -> None:
        while self.keep is not None and self.open and (oldest := next(iter(self.open))) + self.keep < now:
            self._drop(oldest)

    def bar(self, ts, high: float, low: float, kind: int, edge: float) -> tuple[int, int]:
        """(filled by this bar, open after it)."""
        self.expire(ts)
        if kind:
            self.open[ts] = self.added[ts] = (kind, edge)
            heapq.heappush(self.heaps[kind], (-kind * edge, ts))
        filled = 0
        for side, heap in self.heaps.items():
            while heap and (low <= -heap[0][0] if side == 1 else high >= heap[0][0]):
                born = heapq.heappop(heap)[1]
                if born in self.open:  # else it has expired
                    self._drop(born)
                    filled += 1
        return filled, len(self.open)


def gap_register(df: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """gap_new (1, -1, 0) on the third bar of a gap, gaps_filled and gaps_open on every bar (see Gaps)."""
    h2, l2 = prev("high", 2), prev("low", 2)
    kind = F.when(F.col("low") > h2, 1).when(F.col("high") < l2, -1).otherwise(0)
    rows = df.withColumns({"__k": kind, "__edge": F.when(F.col("low") > h2, h2).when(F.col("high") < l2, l2)})

    def step(rows):
        gaps = Gaps(keep)
        for ts, high, low, kind, edge in rows:
            yield kind, *gaps.bar(ts, high, low, kind, edge)

    return ordered_fold(rows, ["ts", "high", "low", "__k", "__edge"], ["gap_new", "gaps_filled", "gaps_open"], step).drop("__k", "__edge")


class Pools:
    """Pools of equal swing highs (side 1) and lows (side -1): (side, number) -> [price, touches, swept].

    A swing joins the oldest pool of its side for which abs(swing - price) / price is at most ``tolerance``. A pool is swept once,
    by the first bar beyond its price. So no swing joins a pool at zero (each zero founds its own), and a pool below zero takes any swing.
    Pools above zero are further apart than the tolerance, so few are compared, and their number is bounded by the range of prices.
    changed: pools that differ from what was stored.
    """

    def __init__(self, tolerance: float, stored: dict | None = None) -> None:
        self.tolerance, self.pools = tolerance, {k: list(v) for k, v in (stored or {}).items()}
        self.prices = {side: sorted((p[0], n) for (s, n), p in self.pools.items() if s == side) for side in (1, -1)}
        self.waiting = {side: [(side * p[0], n) for (s, n), p in self.pools.items() if s == side and not p[2]] for side in (1, -1)}
        for heap in self.waiting.values():
            heapq.heapify(heap)
        self.changed: set = set()

    def join(self, side: int, price: float) -> int:
        """Touches of the pool that a swing joins or founds."""
        own = self.prices[side]
        below, above = bisect_left(own, (0.0, -1)), bisect_left(own, (0.0, 1 << 62))
        lo = max(above, bisect_left(own, (price / (1 + self.tolerance) * (1 - 1e-12), -1)))
        hi = bisect_left(own, (price / (1 - self.tolerance) * (1 + 1e-12), 1 << 62)) if self.tolerance < 1 else len(own)
        near = [number for p, number in own[:below] + own[lo:hi] if abs(price - p) / p <= self.tolerance]
        number = min(near, default=len(own))
        if not near:
            insort(own, (price, number))
            heapq.heappush(self.waiting[side], (side * price, number))
            self.pools[side, number] = [price, 0, False]
        self.pools[side, number][1] += 1
        self.changed.add((side, number))
        return self.pools[side, number][1]

    def bar(self, high: float, low: float, top: float | None, bottom: float | None) -> tuple:
        joined = [None if p is None else self.join(side, p) for side, p in ((1, top), (-1, bottom))]
        swept = []
        for side, reach in ((1, high), (-1, low)):
            n, heap = 0, self.waiting[side]
            while heap and heap[0][0] < side * reach:
                number = heapq.heappop(heap)[1]
                self.pools[side, number][2] = True
                self.changed.add((side, number))
                n += 1
            swept.append(n)
        return (*joined, *swept)


def liquidity_pools(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Touches of the pool that a swing (from swings()) joins or founds, and how many pools each bar sweeps (see Pools)."""

    def step(rows):
        pools = Pools(tolerance)
        for row in rows:
            yield pools.bar(*row)

    return ordered_fold(df, ["high", "low", "swing_high", "swing_low"], ["pool_high_touches", "pool_low_touches", "swept_highs", "swept_lows"], step)


def soft_confirmations(df: DataFrame, swing: str = "zz", price: str = "zz_price", move: float = 1.0, bars: int = 10, atr_times: float = 1.5, atr_col: str = "atr") -> DataFrame:
    """What speaks for the move away from the last swing, each 0 or 1, and their sum soft_strength; with pivot_age and pivot_distance.

    sc_deviation: price has moved by ``move``; sc_time: ``bars`` bars have passed; sc_structure: the swing is a lower high
    or a higher low than the one before of its kind; sc_atr: the move is atr_times the ATR. All 0 before the first swing.
    """
    is_swing = F.col(swing) != 0
    out = df.withColumn("__n", F.row_number().over(series()))
    last = lambda c: F.last(F.when(is_swing, F.col(c)), True).over(_upto())
    out = out.withColumns({"__kind": last(swing), "__price": last(price), "__at": last("__n")})
    before = lambda kind: F.last(F.when(F.col(swing) == kind, F.col(price)), True).over(_upto(-1))
    gone = F.when(F.col("__kind") == -1, F.col("high") - F.col("__price")).otherwise(F.col("__price") - F.col("low"))
    structure = ((F.col(swing) == 1) & (F.col(price) < before(1))) | ((F.col(swing) == -1) & (F.col(price) > before(-1)))
    out = out.withColumns({"__gone": gone, "pivot_age": F.col("__n") - F.col("__at"), "pivot_distance": F.abs(F.col("close") - F.col("__price"))})
    out = out.withColumns({
        "sc_deviation": flag(F.col("__gone") >= move), "sc_time": flag(F.col("pivot_age") >= bars),
        "sc_structure": flag(structure), "sc_atr": flag(F.col("__gone") >= atr_times * F.col(atr_col)),
    })
    return out.withColumn("soft_strength", F.expr("sc_deviation + sc_time + sc_structure + sc_atr")).drop("__n", "__kind", "__price", "__at", "__gone")


def level_breaks(df: DataFrame, resistance: str, support: str, window: int = 20, times: float = 1.5) -> DataFrame:
    """level_break (1, -1, 0): closes beyond a level; break_confirmed: on more than ``times`` the mean volume of the bars before."""
    usual = F.avg("volume").over(series().rowsBetween(-window, -1))
    kind = F.when(F.col("close") > F.col(resistance), 1).when(F.col("close") < F.col(support), -1).otherwise(0)
    out = df.withColumns({"level_break": kind, "__usual": usual})
    return out.withColumn("break_confirmed", flag((F.col("level_break") != 0) & (F.col("volume") > times * F.col("__usual")))).drop("__usual")


def trend_regime(df: DataFrame, adx: str = "adx", atr_ratio: str = "atr_ratio", slope: str = "slope", trending: float = 25.0, volatile: float = 0.8) -> DataFrame:
    """market_regime (trending_up, trending_down, volatile, ranging), its strength, and how many bars it has lasted (0 on a change).

    A series starts out as ranging. A null ADX or ratio is never enough for its regime; a null slope counts as 0.
    """
    down = F.coalesce(F.col(slope), F.lit(0.0)) < 0
    label = F.when(F.col(adx) >= trending, F.when(down, "trending_down").otherwise("trending_up")).when(F.col(atr_ratio) >= volatile, "volatile").otherwise("ranging")
    strength = F.when(F.col("market_regime").startswith("trending"), F.least(F.col(adx) / (2 * trending), F.lit(1.0))).when(F.col("market_regime") == "volatile", F.col(atr_ratio)).otherwise(1 - F.col(adx) / trending)
    out = df.withColumn("market_regime", label).withColumn("regime_strength", strength)
    out = out.withColumn("__same", flag(F.col("market_regime") == F.coalesce(prev("market_regime"), F.lit("ranging"))))
    return run_length(out, "__same", "regime_duration").drop("__same")


def signal_confluence(signals: DataFrame, order: tuple[str, ...] = ("ts", "kind"), newest: int = 5) -> DataFrame:
    """confluence_score after every signal (kind, value, weight) of a series: the weighted mean over the ``newest`` signals of each kind.

    A signal adds itself and takes away the one of its kind that it pushes out, so one running sum over the series suffices.
    A null value counts as 1, a null weight as 1. ``order`` must order a series' signals fully.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    worth = weight * F.coalesce(F.col("value").cast("double"), F.lit(1.0))
    own, whole = Window.partitionBy(*KEY, "kind").orderBy(*order), Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = signals.withColumns({"__w": weight, "__v": worth})
    change = lambda c: F.col(c) - F.coalesce(F.lag(c, newest).over(own), F.lit(0.0))
    out = out.withColumns({"__dw": change("__w"), "__dv": change("__v")})
    return out.withColumn("confluence_score", F.coalesce(ratio(F.sum("__dv").over(whole), F.sum("__dw").over(whole)), F.lit(0.0))).drop("__w", "__v", "__dw", "__dv")
