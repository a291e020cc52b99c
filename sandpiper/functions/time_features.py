"""Calendar features of a timestamp column, each a projection."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandpiper.sources.candles import MINUTES, series, timeframe


def _flag(test: Column) -> Column:
    return F.coalesce(test.cast("int"), F.lit(0))


def _wave(fn, value: Column, period: int) -> Column:
    return fn(2 * math.pi * value / period)


def _session(start: int, end: int) -> Callable[[Column], Column]:
    return lambda t: _flag((F.hour(t) >= start) & (F.hour(t) < end))


#: Name of every feature with its expression.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour,
    "minute": F.minute,
    "day_of_week": F.weekday,
    "day_of_month": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "week_of_year": F.weekofyear,
    "month": F.month,
    "quarter": F.quarter,
    "session_asia": _session(0, 8),
    "session_london": _session(8, 16),
    "session_newyork": _session(13, 21),
    "is_weekend": lambda t: _flag(F.weekday(t) >= 5),
    "is_month_start": lambda t: _flag(F.dayofmonth(t) == 1),
    "is_month_end": lambda t: _flag(F.to_date(t) == F.last_day(t)),
    "is_quarter_start": lambda t: _flag((F.dayofmonth(t) == 1) & (F.month(t) % 3 == 1)),
    "is_quarter_end": lambda t: _flag((F.to_date(t) == F.last_day(t)) & (F.month(t) % 3 == 0)),
    "sin_hour": lambda t: _wave(F.sin, F.hour(t), 24),
    "cos_hour": lambda t: _wave(F.cos, F.hour(t), 24),
    "sin_day_of_week": lambda t: _wave(F.sin, F.weekday(t), 7),
    "cos_day_of_week": lambda t: _wave(F.cos, F.weekday(t), 7),
    "sin_month": lambda t: _wave(F.sin, F.month(t) - 1, 12),
    "cos_month": lambda t: _wave(F.cos, F.month(t) - 1, 12),
    "market_open_flag": lambda t: _flag(F.hour(t) == 8),
    "market_close_flag": lambda t: _flag(F.hour(t) == 21),
    "is_new_day": lambda t: F.when(F.lag(t).over(series()).isNull() | (F.to_date(F.lag(t).over(series())) != F.to_date(t)), 1).otherwise(0),
}
#: Those that say nothing on bars of a day or more.
INTRADAY = ("hour", "minute", "session_asia", "session_london", "session_newyork", "sin_hour", "cos_hour", "market_open_flag", "market_close_flag")


def check_time_features(names: list[str], tf: str | None = None) -> None:
    """Unknown names, and intraday ones on a timeframe of a day or more, are errors."""
    if unknown := [n for n in names if n not in FEATURES]:
        raise ValueError(f"unknown time features {unknown}")
    if tf is not None and MINUTES[timeframe(tf)] >= MINUTES["D1"] and (odd := [n for n in names if n in INTRADAY]):
        raise ValueError(f"{odd} need a timeframe below D1")


def add_time_features(bars: DataFrame, names: list[str] | None = None, tf: str | None = None) -> DataFrame:
    """The named features (all if none are named) of ts."""
    names = list(FEATURES) if names is None else names
    check_time_features(names, tf)
    return bars.withColumns({n: FEATURES[n](F.col("ts")) for n in names})
