"""Live forms of the indicators that specifications can name: the same values as over the whole table, from what each series keeps.

A live form is made of parts: the newest n - 1 values of an input (Tail), a running number (Total), and the last value of a
recurrence y = a * y_before + b (Recurrence). A batch's rows go through whole arrays; nothing is kept but these parts, so
a series' state is bounded by its longest window. NaN stands for null.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandpiper.functions.spec import Spec
from sandpiper.operators.recursive import MEANS, scan
from sandpiper.operators.rolling import EPS
from sandpiper.plans.features import plan
from sandpiper.plans.registry import ALL
from sandpiper.sources.candles import KEY
from sandpiper.streaming.ordered import Arrays, InOrder, fold

#: Rows that go through the arrays at a time; with a window's length they bound a task's memory.
SLICE_ROWS = 2048
BAR = ["open", "high", "low", "close", "volume"]
NAN = float("nan")


class Tail:
    """Windows of n rows that end on each new row, from the n - 1 rows before; NaN where a series is shorter."""

    def __init__(self, n: int) -> None:
        self.n, self.kept = n, np.full(n - 1, NAN)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        full = np.concatenate([self.kept, x])
        self.kept = full[len(x) :]
        return np.lib.stride_tricks.sliding_window_view(full, self.n)

    def before(self, x: np.ndarray) -> np.ndarray:
        """The value n - 1 rows back."""
        return self(x)[:, 0]


class Total:
    """A running sum; NaN adds nothing."""

    def __init__(self, _: int = 0) -> None:
        self.kept = np.zeros(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.kept[0] + np.cumsum(np.nan_to_num(x))
        self.kept = out[-1:]
        return out

    def count(self, x: np.ndarray) -> np.ndarray:
        return self(~np.isnan(x) * 1.0)


class Recurrence:
    """y = a * y_before + b; a NaN b gives NaN and keeps y, the first other b is the seed."""

    def __init__(self, _: int = 0) -> None:
        self.kept = np.full(1, NAN)

    def __call__(self, a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
        out = scan(np.concatenate([[0.0], np.broadcast_to(a, b.shape)]), np.concatenate([self.kept, b]))
        seen = out[~np.isnan(out)]
        self.kept = seen[-1:] if len(seen) else self.kept
        return out[1:]

    def smooth(self, x: np.ndarray, alpha: float) -> np.ndarray:
        """Exponential mean with the first value as its seed."""
        b = alpha * x
        if np.isnan(self.kept[0]):
            first = np.flatnonzero(~np.isnan(x))[:1]
            b[first] = x[first]
        return self(1 - alpha, b)


class Machine:
    """A step by step fold: its state is a few numbers, NaN before the first row."""

    def __init__(self, n: int) -> None:
        self.kept = np.full(n, NAN)

    def run(self, step: Callable[..., tuple[tuple, tuple]], *inputs: np.ndarray) -> list[np.ndarray]:
        state, outs = tuple(self.kept), []
        for row in zip(*(x.tolist() for x in inputs), strict=True):
            state, out = step(state, *row)
            outs.append(out)
        self.kept = np.array(state)
        return list(np.array(outs, np.float64).T)


class Parts:
    """The parts of one live form, in the order in which it asks for them; what they keep can be taken out and put back."""

    def __init__(self) -> None:
        self.all: list = []

    def add(self, part):
        self.all.append(part)
        return part

    def tail(self, n: int) -> Tail:
        return self.add(Tail(n))

    def total(self) -> Total:
        return self.add(Total())

    def recurrence(self) -> Recurrence:
        return self.add(Recurrence())

    def machine(self, n: int) -> Machine:
        return self.add(Machine(n))

    # -- what several forms share ---------------------------------------------

    def rolling(self, n: int, least: int | None, of: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        """``of`` each window that has ``least`` values (n, if not given)."""
        tail, least = self.tail(n), n if least in (None, -1) else least

        def run(x: np.ndarray) -> np.ndarray:
            w = tail(x)
            have = (~np.isnan(w)).sum(1)
            return np.where((have >= least) & (have > 0), of(w), NAN)

        return run

    def seeded(self, n: int, alpha: float) -> Callable[[np.ndarray], np.ndarray]:
        """Exponential mean whose seed is the plain mean of the first n values."""
        tail, count, y = self.tail(n), self.total(), self.recurrence()

        def run(x: np.ndarray) -> np.ndarray:
            k = count.count(x)
            return y(1 - alpha, np.where(k == n, mean(tail(x)), np.where(k > n, alpha * x, NAN)))

        return run

    def true_range(self) -> Callable[[dict], np.ndarray]:
        last = self.tail(2)

        def run(b: dict) -> np.ndarray:
            before = last.before(b["close"])
            return np.fmax(np.fmax(b["high"] - b["low"], np.abs(b["high"] - before)), np.abs(b["low"] - before))

        return run

    def weighted(self, n: int, least: int | None = None) -> Callable[[np.ndarray], np.ndarray]:
        """Weights 1 .. n, the newest heaviest; values that are missing leave the lightest out."""

        def of(w: np.ndarray) -> np.ndarray:
            have = ~np.isnan(w)
            weight = np.where(have, n + 1 - np.cumsum(have[:, ::-1], axis=1)[:, ::-1], 0)
            return (np.nan_to_num(w) * weight).sum(1) / np.maximum(weight.sum(1), 1)

        return self.rolling(n, least, of)


def mean(w: np.ndarray) -> np.ndarray:
    have = (~np.isnan(w)).sum(1)
    return np.where(have > 0, np.nan_to_num(w).sum(1) / np.maximum(have, 1), NAN)


def deviation(w: np.ndarray, less: int = 0) -> np.ndarray:
    have = (~np.isnan(w)).sum(1)
    squares = np.nan_to_num((w - mean(w)[:, None]) ** 2).sum(1)
    return np.where(have > less, np.sqrt(squares / np.maximum(have - less, 1)), NAN)


def highest(w: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(w), -np.inf, w).max(1)


def lowest(w: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(w), np.inf, w).min(1)


def added(w: np.ndarray) -> np.ndarray:
    return np.nan_to_num(w).sum(1)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), NAN), where=b != 0)


def live_sma(p: Parts, column, period, min_periods):
    of = p.rolling(period, min_periods, mean)
    return lambda b: [of(b[column])]


def live_wma(p: Parts, column, period, min_periods):
    of = p.weighted(period, min_periods)
    return lambda b: [of(b[column])]


def _exponential(p: Parts, kind: str, column, period, min_periods):
    weights = [w for w in MEANS[kind] if w]
    levels, count, least = [p.recurrence() for _ in weights], p.total(), period if min_periods == -1 else min_periods

    def run(b):
        x, out = b[column], 0.0
        seen = count.count(x)
        for weight, level in zip(weights, levels, strict=True):
            x = level.smooth(x, 2 / (period + 1))
            out = out + weight * x
        return [np.where(seen >= least, out, NAN)]

    return run


def live_ema(p: Parts, column, period, min_periods):
    return _exponential(p, "ema", column, period, min_periods)


def live_dema(p: Parts, column, period, min_periods):
    return _exponential(p, "dema", column, period, min_periods)


def live_tema(p: Parts, column, period, min_periods):
    return _exponential(p, "tema", column, period, min_periods)


def live_roc(p: Parts, column, period):
    tail = p.tail(period + 1)

    def run(b):
        before = tail.before(b[column])
        return [ratio(b[column] - before, before) * 100]

    return run


def live_rsi(p: Parts, column, period, method):
    alpha = {"ema": 2 / (period + 1), "wilders": 1 / period}[method]
    last, gains, losses = p.tail(2), p.seeded(period, alpha), p.seeded(period, alpha)

    def run(b):
        change = b[column] - last.before(b[column])
        up, down = gains(np.maximum(change, 0)), losses(np.maximum(-change, 0))
        return [np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + ratio(up, down)))]

    return run


def live_true_range(p: Parts):
    of = p.true_range()
    return lambda b: [of(b)]


def live_atr(p: Parts, period, method):
    tr = p.true_range()
    of = p.rolling(period, None, mean) if method == "classic" else p.seeded(period, {"wilder": 1 / period, "ema": 2 / (period + 1)}[method])
    return lambda b: [of(tr(b))]


def live_macd(p: Parts, column, fast, slow, signal):
    quick, long, own, count, signals = p.recurrence(), p.recurrence(), p.recurrence(), p.total(), p.total()

    def run(b):
        x = b[column]
        line = quick.smooth(x, 2 / (fast + 1)) - long.smooth(x, 2 / (slow + 1))
        line = np.where(count.count(x) < slow, NAN, line)
        mine = own.smooth(line, 2 / (signal + 1))
        mine = np.where(signals.count(line) < signal, NAN, mine)
        return [line, mine, line - mine]

    return run


def _bands(x, middle, reach):
    upper, lower = middle + reach, middle - reach
    return [upper, middle, lower, upper - lower, ratio(x - lower, upper - lower)]


def live_bollinger_bands(p: Parts, column, period, multiplier, min_periods):
    middle, spread = p.rolling(period, min_periods, mean), p.rolling(period, min_periods, deviation)
    return lambda b: _bands(b[column], middle(b[column]), multiplier * spread(b[column]))


def live_keltner(p: Parts, period, multiplier):
    middle, count, tr, atr = p.recurrence(), p.total(), p.true_range(), p.seeded(period, 1 / period)
    return lambda b: _bands(b["close"], np.where(count.count(b["close"]) >= period, middle.smooth(b["close"], 2 / (period + 1)), NAN), multiplier * atr(tr(b)))


def live_stochastic(p: Parts, k_period, d_period, smooth_k):
    top, bottom, k, d = p.rolling(k_period, None, highest), p.rolling(k_period, None, lowest), p.rolling(smooth_k, 1, mean), p.rolling(d_period, 1, mean)

    def run(b):
        hh, ll = top(b["high"]), bottom(b["low"])
        raw = np.where(hh == ll, 0.0, 100 * ratio(b["close"] - ll, hh - ll))
        fast = np.where(np.isnan(raw), NAN, k(raw))
        return [fast, np.where(np.isnan(fast), NAN, d(fast))]

    return run


def _typical(b):
    return (b["high"] + b["low"] + b["close"]) / 3


def live_cci(p: Parts, period, min_periods):
    middle = p.rolling(period, min_periods, mean)
    spread = p.rolling(period, 1, lambda w: mean(np.abs(w - mean(w)[:, None])))

    def run(b):
        tp = _typical(b)
        return [(tp - middle(tp)) / (0.015 * spread(tp) + EPS)]

    return run


def live_mfi(p: Parts, period):
    last, ups, downs = p.tail(2), p.rolling(period, None, added), p.rolling(period, None, added)

    def run(b):
        tp = _typical(b)
        before, flow = last.before(tp), tp * b["volume"]
        known = np.isnan(before)
        up = ups(np.where(known, NAN, np.where(tp > before, flow, 0.0)))
        down = downs(np.where(known, NAN, np.where(tp < before, flow, 0.0)))
        return [np.where(up + down == 0, 50.0, 100 * ratio(up, up + down))]

    return run


def live_obv(p: Parts):
    last, total = p.tail(2), p.total()
    return lambda b: [total(np.nan_to_num(np.sign(b["close"] - last.before(b["close"]))) * b["volume"])]


def live_williams_r(p: Parts, period, min_periods):
    top, bottom = p.rolling(period, min_periods, highest), p.rolling(period, min_periods, lowest)

    def run(b):
        hh, ll = top(b["high"]), bottom(b["low"])
        return [np.where(hh - ll >= EPS, -100 * ratio(hh - b["close"], hh - ll), NAN)]

    return run


def live_parabolic_sar(p: Parts, af_start, af_step, af_max):
    machine = p.machine(4)

    def step(state, high, low):
        sar, extreme, rate, rising = state
        if sar != sar:
            return (low, high, af_start, 1.0), (NAN,)
        sar += rate * (extreme - sar)
        if high > extreme if rising else low < extreme:
            extreme, rate = (high if rising else low), min(rate + af_step, af_max)
        if low < sar if rising else high > sar:
            rising = 1.0 - rising
            sar, extreme, rate = extreme, (high if rising else low), af_start
        return (sar, extreme, rate, rising), (sar,)

    return lambda b: machine.run(step, b["high"], b["low"])


def live_heikin_ashi(p: Parts):
    last, opens = p.tail(2), p.recurrence()

    def run(b):
        close = (b["open"] + b["high"] + b["low"] + b["close"]) / 4
        before = last.before(close)
        start = opens(0.5, np.where(np.isnan(before), (b["open"] + b["close"]) / 2, before / 2))
        return [start, np.fmax(np.fmax(b["high"], start), close), np.fmin(np.fmin(b["low"], start), close), close]

    return run


def live_supertrend(p: Parts, period, multiplier):
    tr, atr, machine = p.true_range(), p.seeded(period, 1 / period), p.machine(4)

    def step(state, mid, close, width):
        upper, lower, before, trend = state
        trend = 1.0 if trend != trend else trend
        if width != width:
            return (upper, lower, close, trend), (NAN, 1.0)
        top, bottom, fresh = mid + multiplier * width, mid - multiplier * width, upper != upper
        upper = top if fresh or before > upper else min(top, upper)
        lower = bottom if fresh or before < lower else max(bottom, lower)
        if not fresh and (close <= lower if trend == 1 else close >= upper):
            trend = -trend
        return (upper, lower, close, trend), (lower if trend == 1 else upper, trend)

    return lambda b: machine.run(step, (b["high"] + b["low"]) / 2, b["close"], atr(tr(b)))


def live_aroon(p: Parts, period):
    def since(sign):
        return p.rolling(period, None, lambda w: (period - np.argmax(np.where(np.isnan(w), -np.inf, sign * w)[:, ::-1], axis=1)) / period * 100)

    ups, downs = since(1), since(-1)

    def run(b):
        up, down = ups(b["high"]), downs(b["low"])
        return [up, down, up - down]

    return run


def live_kama(p: Parts, column, period, fast_span, slow_span):
    quick, slow = 2 / (fast_span + 1), 2 / (slow_span + 1)
    last, path, far, count, y = p.tail(2), p.rolling(period - 1, 1, added), p.tail(period), p.total(), p.recurrence()

    def run(b):
        x = b[column]
        way = path(np.abs(x - last.before(x)))
        er = np.where(way < 1e-9, 0.0, ratio(np.abs(x - far.before(x)), way))
        sc, k = (er * (quick - slow) + slow) ** 2, count.count(x)
        return [y(1 - sc, np.where(k == period, x, np.where(k > period, sc * x, NAN)))]

    return run


def live_hma(p: Parts, column, period):
    half, full, last, have = p.weighted(max(1, period // 2), 1), p.weighted(period, 1), p.weighted(max(1, int(period**0.5)), 1), p.rolling(period, None, mean)

    def run(b):
        x = b[column]
        out = last(2 * half(x) - full(x))
        return [np.where(np.isnan(have(x)), NAN, out)]

    return run


def live_donchian(p: Parts, period):
    top, bottom = p.rolling(period, None, highest), p.rolling(period, None, lowest)

    def run(b):
        hh, ll = top(b["high"]), bottom(b["low"])
        return [hh, ll, (hh + ll) / 2, hh - ll, ratio(b["close"] - ll, hh - ll)]

    return run


def live_zscore(p: Parts, column, period):
    middle, spread = p.rolling(period, None, mean), p.rolling(period, None, lambda w: deviation(w, 1))
    return lambda b: [ratio(b[column] - middle(b[column]), spread(b[column]))]


def live_linreg_slope(p: Parts, column, period):
    place = np.arange(period) - (period - 1) / 2
    of = p.rolling(period, None, lambda w: ((w - mean(w)[:, None]) * place).sum(1) / max((place**2).sum(), 1e-300))
    return lambda b: [of(b[column])]


def live_adx(p: Parts, period):
    last_high, last_low, tr = p.tail(2), p.tail(2), p.true_range()
    plus, minus, width, own = (p.seeded(period, 1 / period) for _ in range(4))

    def run(b):
        up, down, span = b["high"] - last_high.before(b["high"]), last_low.before(b["low"]) - b["low"], tr(b)
        known = ~np.isnan(up)
        moves = [np.where(known, np.where((x > y) & (x > 0), x, 0.0), NAN) for x, y in ((up, down), (down, up))]
        base = width(np.where(known, span, NAN))
        pos, neg = (100 * ratio(of(m), base) for of, m in zip((plus, minus), moves, strict=True))
        return [pos, neg, own(100 * ratio(np.abs(pos - neg), pos + neg))]

    return run


LIVE: dict[str, Callable] = {name.removeprefix("live_"): f for name, f in list(globals().items()) if name.startswith("live_")}


def validate_registry() -> list[str]:
    """What keeps the registry and the live forms apart: entries without one, forms without an entry, parameters that differ."""
    found = [f"{name} has no entry" for name in LIVE if name not in {f.name for f in ALL}]
    for feature in ALL:
        if feature.name not in LIVE:
            found.append(f"{feature.name} has no live form")
            continue
        known, own = [p.name for p in feature.params], list(inspect.signature(LIVE[feature.name]).parameters)[1:]
        if set(own) - set(known):
            found.append(f"{feature.name}: the live form asks for {sorted(set(own) - set(known))}")
    return found


class LiveForm:
    """One specification over the rows of one series, in slices; kept() and restore() carry it from batch to batch."""

    def __init__(self, spec: Spec) -> None:
        make, args = LIVE[spec.feature.name], dict(spec.args)
        self.parts = Parts()
        self.names = [spec.column(o) for o in spec.feature.outputs]
        self.run = make(self.parts, **{k: args[k] for k in list(inspect.signature(make).parameters)[1:]})

    def kept(self) -> list[np.ndarray]:
        return [p.kept for p in self.parts.all]

    def restore(self, kept: list[np.ndarray]) -> None:
        for part, k in zip(self.parts.all, kept, strict=True):
            part.kept = k

    def __call__(self, bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(bars["close"])
        with np.errstate(invalid="ignore", divide="ignore"):
            made = [self.run({c: x[at : at + SLICE_ROWS] for c, x in bars.items()}) for at in range(0, n, SLICE_ROWS)]
        return {name: np.concatenate([m[i] for m in made]) for i, name in enumerate(self.names)}


class LiveIndicators(InOrder):
    """Every named indicator of a series' bars. A specification that is new to a running stream starts with the next bar."""

    def __init__(self, specs: list[Spec], waits: bool) -> None:
        super().__init__(BAR, [], waits)
        self.specs = specs

    def setup(self, handle) -> None:
        self.parts = Arrays(handle, "parts")

    def advance(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept, bars, out, left = self.parts.load(), {c: rows[c].to_numpy() for c in BAR}, {}, {}
        for spec in self.specs:
            form = LiveForm(spec)
            names = [f"{spec.canonical}#{i}" for i in range(len(form.parts.all))]
            if names and names[0] in kept:
                form.restore([kept[n] for n in names])
            out |= form(bars)
            left |= dict(zip(names, form.kept(), strict=True))
        self.parts.save(left)
        made = pd.DataFrame({**dict(zip(KEY, key, strict=True)), "t_us": rows["t_us"], **{c: rows[c] for c in BAR}} | out)
        return made[[*KEY, "t_us", *BAR, *out]]


def live_indicators(bars: DataFrame, specs: list[str], tf: str, late: str | None = None) -> DataFrame:
    """A stream's closed bars with the columns that features() gives them over the whole table, from the state each series keeps.

    late: how long bars may come after newer ones (see ordered.fold); None where they come in order, as from live_candles(). A restart goes on
    from the checkpoint. Bars of other timeframes are left out.
    """
    wanted = plan(specs, tf)
    if other := [s.canonical for s in wanted if s.tf != wanted[0].tf]:
        raise ValueError(f"{other} aren't on {wanted[0].tf}")
    columns = [c for s in wanted for c in LiveForm(s).names]
    rows = bars.filter(F.col("tf") == wanted[0].tf)
    return fold(rows, LiveIndicators(wanted, late is not None), list(KEY), ", ".join(f"{c} double" for c in [*BAR, *columns]), late)
