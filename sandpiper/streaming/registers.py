"""Live registers of gaps, zones, pools and level breaks, and live alignment of timeframes: stream equals batch, late bars included."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandpiper.operators.joins import close_time
from sandpiper.operators.structure import Gaps, Pools
from sandpiper.sources.candles import KEY, MINUTES, span, timeframe
from sandpiper.streaming.indicators import NAN, SLICE_ROWS, Parts, highest, lowest, mean
from sandpiper.streaming.ordered import Arrays, InOrder, fold

HIGH_LOW = ["high", "low"]


def gap_parts(p: Parts, lookback: int = 2):
    """kind (1, -1, 0), and the edges of the gap between a bar and the one ``lookback`` before: of the older bar, of the newer one."""
    tops, bottoms = p.tail(lookback + 1), p.tail(lookback + 1)

    def run(b):
        high, low = tops.before(b["high"]), bottoms.before(b["low"])
        up, down = b["low"] > high, b["high"] < low
        return np.where(up, 1, np.where(down, -1, 0)), np.where(up, high, np.where(down, low, NAN)), np.where(up, b["low"], np.where(down, b["high"], NAN))

    return run


def swing_parts(p: Parts, left: int, right: int):
    """swing_high and swing_low as swings() gives them."""
    n = left + right + 1
    tops, bottoms, rows = p.tail(n), p.tail(n), p.total()

    def run(b):
        full = rows(np.ones(len(b["high"]))) >= n
        high, low = tops(b["high"]), bottoms(b["low"])
        at = n - 1 - right
        return np.where(full & (high[:, at] == highest(high)), high[:, at], NAN), np.where(full & (low[:, at] == lowest(low)), low[:, at], NAN)

    return run


class Register(InOrder):
    """A fold with parts (rings and sums) and, beside them, a map from an item to what is known of it."""

    def __init__(self, fields: list[str], waits: bool, make) -> None:
        super().__init__(fields, [], waits)
        self.make = make

    #: Key and value of the map, as DDL.
    KINDS: tuple[str, str] | None = None

    def setup(self, handle) -> None:
        self.arrays = Arrays(handle, "parts")
        if self.KINDS:
            self.items = handle.getMapState("items", *self.KINDS)

    def computed(self, rows: pd.DataFrame) -> list[np.ndarray]:
        """What the parts make of the rows, in slices."""
        parts = Parts()
        run, kept = self.make(parts), self.arrays.load()
        for i, part in enumerate(parts.all):
            part.kept = kept.get(str(i), part.kept)
        columns = {c: rows[c].to_numpy() for c in self.fields[1:]}
        with np.errstate(invalid="ignore", divide="ignore"):
            made = [run({c: x[at : at + SLICE_ROWS] for c, x in columns.items()}) for at in range(0, len(rows), SLICE_ROWS)]
        self.arrays.save({str(i): part.kept for i, part in enumerate(parts.all)})
        return [np.concatenate(c) for c in zip(*made, strict=True)]

    def out(self, key: tuple, rows: pd.DataFrame, **columns) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip(KEY, key, strict=True)), "t_us": rows["t_us"], **columns})


class GapRegister(Register):
    KINDS = ("born long", "kind int, edge double")

    def __init__(self, waits: bool, keep: timedelta | None) -> None:
        super().__init__(HIGH_LOW, waits, gap_parts)
        self.keep = None if keep is None else keep // timedelta(microseconds=1)

    def _stored(self) -> Gaps:
        return Gaps(self.keep, {k[0]: tuple(v) for k, v in self.items.iterator()})

    def _store(self, gaps: Gaps) -> None:
        for born in gaps.gone:
            self.items.removeKey((born,))
        for born, gap in gaps.added.items():
            self.items.updateValue((born,), gap)
            if self.waits and self.keep is not None:
                self._wake(born + self.keep + 1)

    def advance(self, key, rows):
        kind, edge, _ = self.computed(rows)
        gaps = self._stored()
        made = [gaps.bar(*row) for row in zip(rows["t_us"].tolist(), rows["high"].tolist(), rows["low"].tolist(), kind.tolist(), edge.tolist(), strict=True)]
        self._store(gaps)
        filled, still = np.array(made).T
        return self.out(key, rows, gap_new=kind, gaps_filled=filled, gaps_open=still)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Rows that are due first; then gaps that no later bar can fill any more go, whether their series has further bars or not."""
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.keep is not None:
            gaps = self._stored()
            gaps.expire(timerValues.getCurrentWatermarkInMs() * 1000)
            self._store(gaps)


class ZoneLife(Register):
    """Zones are the fair value gaps, known one bar later; row numbers count from the series' first bar."""

    KINDS = ("row long", "born long, kind int, bottom double, top double, touched long, filled long")

    def __init__(self, waits: bool, life: int, lookback: int) -> None:
        def make(p: Parts):
            gap, number = gap_parts(p, lookback), p.total()
            kinds, bottoms, tops = p.tail(2), p.tail(2), p.tail(2)

            def run(b):
                kind, old, new = gap(b)
                bottom, top = np.where(kind == 1, old, np.where(kind == -1, new, NAN)), np.where(kind == 1, new, np.where(kind == -1, old, NAN))
                return number(np.ones(len(kind))), np.nan_to_num(kinds.before(kind.astype(float))), bottoms.before(bottom), tops.before(top)

            return run

        super().__init__([*HIGH_LOW, "close"], waits, make)
        self.life = life

    def advance(self, key, rows):
        number, kind, bottom, top = self.computed(rows)
        alive = {k[0]: list(v) for k, v in self.items.iterator()}
        stored, changed, events = set(alive), set(), []
        for t, n, high, low, close, k, lower, upper in zip(rows["t_us"].tolist(), number.astype(int).tolist(), *(rows[c].tolist() for c in ("high", "low", "close")), kind.tolist(), bottom.tolist(), top.tolist(), strict=True):
            for row, zone in sorted(alive.items()):
                born, side, under, over, touched, filled = zone
                age = n - row
                for event, at, done in (("touched", 4, low <= over if side == 1 else high >= under), ("filled", 5, close < under if side == 1 else close > over)):
                    if done and not zone[at]:
                        zone[at] = age
                        changed.add(row)
                        events.append((t, born, side, under, over, event, age))
                if age >= self.life:
                    events.append((t, born, side, under, over, "over", age))
                    del alive[row]
            if k:
                alive[n] = [t, int(k), lower, upper, 0, 0]
                changed.add(n)
        for row in stored - set(alive):
            self.items.removeKey((row,))
        for row in changed & set(alive):
            self.items.updateValue((row,), tuple(alive[row]))
        out = pd.DataFrame(events, columns=["t_us", "born", "z_kind", "z_bottom", "z_top", "event", "age"])
        out["born"] = pd.to_datetime(out["born"], unit="us")
        return out.assign(**dict(zip(KEY, key, strict=True)))[[*KEY, *out.columns]]


class PoolRegister(Register):
    KINDS = ("side int, number long", "price double, touches long, swept boolean")

    def __init__(self, waits: bool, left: int, right: int, tolerance: float) -> None:
        super().__init__(HIGH_LOW, waits, lambda p: swing_parts(p, left, right))
        self.tolerance = tolerance

    def advance(self, key, rows):
        swings = self.computed(rows)
        pools = Pools(self.tolerance, {tuple(k): v for k, v in self.items.iterator()})
        none = lambda x: [None if v != v else v for v in x.tolist()]
        made = [pools.bar(*row) for row in zip(rows["high"].tolist(), rows["low"].tolist(), *map(none, swings), strict=True)]
        for item in pools.changed:
            self.items.updateValue(item, tuple(pools.pools[item]))
        columns = np.array(made, dtype=np.float64).T
        return self.out(key, rows, swing_high=swings[0], swing_low=swings[1], **dict(zip(("pool_high_touches", "pool_low_touches", "swept_highs", "swept_lows"), columns, strict=True)))


class LevelBreaks(Register):
    def __init__(self, waits: bool, resistance: str, support: str, window: int, times: float) -> None:
        def make(p: Parts):
            usual = p.tail(window + 1)

            def run(b):
                kind = np.where(b["close"] > b[resistance], 1, np.where(b["close"] < b[support], -1, 0))
                return kind, ((kind != 0) & (b["volume"] > times * mean(usual(b["volume"])[:, :-1]))).astype(int)

            return run

        super().__init__(["close", "volume", resistance, support], waits, make)

    def advance(self, key, rows):
        kind, confirmed = self.computed(rows)
        return self.out(key, rows, level_break=kind, break_confirmed=confirmed)


def live_gap_register(bars: DataFrame, keep: timedelta | None = None, late: str | None = None) -> DataFrame:
    """gap_register() of a stream's bars. Open gaps are kept by the bar that made them; with ``keep`` and ``late`` a timer in event time
    removes those that have expired, so that a series without further bars keeps nothing. late: see ordered.fold."""
    return fold(bars, GapRegister(late is not None, keep), list(KEY), "gap_new int, gaps_filled long, gaps_open long", late)


def live_zone_life(bars: DataFrame, life: int = 50, lookback: int = 2, late: str | None = None) -> DataFrame:
    """What happens to a stream's fair value gaps: born, z_kind, z_bottom, z_top, event (touched, filled, over), and its age in bars.

    The first touch and the first fill of each zone are those of zone_life(); ``over`` comes on the zone's last bar. No more than ``life`` zones of a
    series are kept.
    """
    return fold(bars, ZoneLife(late is not None, life, lookback), list(KEY), f"born {dict(bars.dtypes)['ts']}, z_kind int, z_bottom double, z_top double, event string, age long", late)


def live_liquidity_pools(bars: DataFrame, left: int = 5, right: int = 5, tolerance: float = 0.001, late: str | None = None) -> DataFrame:
    """liquidity_pools(swings()) of a stream's bars."""
    return fold(bars, PoolRegister(late is not None, left, right, tolerance), list(KEY), "swing_high double, swing_low double, pool_high_touches double, pool_low_touches double, swept_highs double, swept_lows double", late)


def live_level_breaks(bars: DataFrame, resistance: str, support: str, window: int = 20, times: float = 1.5, late: str | None = None) -> DataFrame:
    """level_breaks() of a stream's bars, which bring their levels with them."""
    return fold(bars, LevelBreaks(late is not None, resistance, support, window, times), list(KEY), "level_break int, break_confirmed int", late)


class Align(InOrder):
    """Base bars with the newest longer bar of each timeframe that has closed; longer bars wait in the state."""

    def __init__(self, own: list[str], columns: list[str], tfs: list[str]) -> None:
        super().__init__(["side", *own, *(f"o_{c}" for c in columns)], ["side"], True)
        self.own, self.columns, self.tfs = own, columns, tfs

    def setup(self, handle) -> None:
        self.last = Arrays(handle, "last")

    def advance(self, key, rows):
        side, kept, out = rows["side"].to_numpy().astype(int), self.last.load(), {}
        base = side == len(self.tfs)
        for i, tf in enumerate(self.tfs):
            values = rows.loc[side == i, [f"o_{c}" for c in self.columns]].to_numpy()
            known = np.vstack([kept.get(tf, np.full(len(self.columns), NAN)), values])
            kept[tf] = known[-1]
            for c, column in zip(self.columns, known[np.cumsum(side == i)[base]].T, strict=True):
                out[f"{tf}_{c}"] = column
        self.last.save(kept)
        found = rows[base]
        return pd.DataFrame({"symbol": key[0], "t_us": found["t_us"], **{c: found[c] for c in self.own}, **out})


def live_align(base: DataFrame, base_tf: str, others: dict[str, DataFrame], columns: list[str], late: str) -> DataFrame:
    """align() of streams: base rows (symbol, ts, numbers) with ``columns`` of longer bars as <TF>_<column>.

    All bars go through one stream by their close, under one watermark: a base bar is given once it has passed the bar's close, so bars may
    come in any order within ``late``. Columns that aren't numbers are left out; numbers become doubles.
    """
    base_tf, tfs = timeframe(base_tf), sorted(map(timeframe, others), key=MINUTES.__getitem__)
    kind = dict(base.dtypes)["ts"]
    own = [c for c, k in base.dtypes if c not in (*KEY, "ts") and k in ("double", "float", "long", "bigint", "int")]
    null = F.lit(None).cast("double")

    def side(bars: DataFrame, tf: str, place: int) -> DataFrame:
        mine = place == len(tfs)
        values = [*((F.col(c).cast("double") if mine else null).alias(c) for c in own), *((null if mine else F.col(c).cast("double")).alias(f"o_{c}") for c in columns)]
        return close_time(bars, tf).select("symbol", "at", F.lit(float(place)).alias("side"), *values)

    rows = side(base, base_tf, len(tfs))
    for place, tf in enumerate(tfs):
        rows = rows.unionByName(side(next(b for t, b in others.items() if timeframe(t) == tf), tf, place))
    names = [*own, *(f"{tf}_{c}" for tf in tfs for c in columns)]
    out = fold(rows, Align(own, columns, tfs), ["symbol"], ", ".join(f"{c} double" for c in names), late, "at")
    return out.select("symbol", F.lit(base_tf).alias("tf"), (F.col("at") - F.expr(span(base_tf))).cast(kind).alias("ts"), *names)
