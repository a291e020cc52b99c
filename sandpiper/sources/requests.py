"""What to scan: ranges in bars or in time, the bars a feature set needs, and news by range."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandpiper.sources.candles import MINUTES, between, last_rows, timeframe, timeframes


@dataclass(frozen=True)
class ScanRequest:
    """Bars of one symbol: by ``number`` (the last start rows without the last end), by ``time`` (from start, before end), or
    by ``periods`` (the last start complete periods of ``period_tf`` without the last end)."""

    symbol: str
    base_tf: str
    tfs: tuple[str, ...]
    mode: str = "number"
    start: object = None
    end: object = None
    period_tf: str = "D1"

    def __post_init__(self):
        if self.mode not in ("number", "time", "periods"):
            raise ValueError(f"mode {self.mode!r}")
        if self.mode != "time" and not (isinstance(self.start, int) and self.start > 0 and (self.end or 0) < self.start):
            raise ValueError("start must be a whole number above end")
        all_tfs = timeframes([self.base_tf, *self.tfs])
        if all_tfs[0] != timeframe(self.base_tf):
            raise ValueError("no timeframe may be shorter than the base")
        object.__setattr__(self, "tfs", tuple(all_tfs))

    def apply(self, bars: DataFrame, now: dt.datetime | None = None, strict: bool = True) -> DataFrame:
        """The bars asked for; a timeframe without any bar of the symbol is an error, if strict."""
        rows = bars.filter((F.col("symbol") == self.symbol) & F.col("tf").isin(*self.tfs))
        if strict and (missing := set(self.tfs) - {r.tf for r in rows.select("tf").distinct().collect()}):
            raise FileNotFoundError(f"no candles of {self.symbol} for {timeframes(missing)}")
        if self.mode == "number":
            return last_rows(rows, self.start, self.end or 0)
        if self.mode == "time":
            return between(rows, self.start, self.end)
        return between(rows, *complete_range(self.period_tf, self.start, self.end or 0, now or dt.datetime.now(dt.UTC).replace(tzinfo=None)))


def period_start(tf: str, at: dt.datetime) -> dt.datetime:
    """The start of the period that holds a time; weeks start on Sunday, months by the calendar."""
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    if tf == "MN1":
        return day.replace(day=1)
    if tf == "W1":
        return day - dt.timedelta(days=(day.weekday() + 1) % 7)
    minutes = MINUTES[tf]
    return day + dt.timedelta(minutes=int((at - day).total_seconds() // 60 // minutes) * minutes)


def complete_range(tf: str, start: int, end: int, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """From the start of the start-th last complete period to the end of the one after the end-th last."""
    tf = timeframe(tf)
    at = period_start(tf, now)

    def back(n: int) -> dt.datetime:
        if tf != "MN1":
            return at - n * dt.timedelta(minutes=MINUTES[tf])
        months = at.year * 12 + at.month - 1 - n
        return at.replace(year=months // 12, month=months % 12 + 1)

    return back(start), back(end)


def required_bars(warmups: DataFrame, depths: DataFrame) -> DataFrame:
    """The larger of warm-up and candle depth for every (symbol, tf); both hold (symbol, tf, needed)."""
    return warmups.unionByName(depths).groupBy("symbol", "tf").agg(F.max("needed").alias("needed"))


def download_plans(spark: SparkSession, symbols: Iterable[str], tfs: Iterable[str], bars: int) -> DataFrame:
    """Every symbol with every timeframe and the bars wanted; both lists are arguments and short."""
    rows = [(s, tf, bars) for s in dict.fromkeys(symbols) for tf in timeframes(tfs)]
    return spark.createDataFrame(rows, "symbol string, tf string, bars long")


def pick_volume(raw: DataFrame) -> DataFrame:
    """volume: tick_volume where a series has any, else real_volume."""
    some = raw.groupBy("symbol", "tf").agg(F.max(F.coalesce("tick_volume", F.lit(0)) != 0).alias("__ticks"))
    return raw.join(some, ["symbol", "tf"]).withColumn("volume", F.when(F.col("__ticks"), F.col("tick_volume")).otherwise(F.col("real_volume"))).drop("__ticks")


def news_range(news: DataFrame, start, end, currencies: list[str] | None = None, impacts: list[str] | None = None) -> DataFrame:
    """Events from start to end, both included, of the currencies and impacts (any case) if given."""
    rows = news.filter(F.col("time_utc").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if currencies:
        rows = rows.filter(F.upper("currency").isin([c.upper() for c in currencies]))
    return rows.filter(F.lower("impact").isin([i.lower() for i in impacts])) if impacts else rows


def instruments(raw: DataFrame) -> DataFrame:
    """Instrument rows with the value of a price unit and of a pip for one lot, and the least stop distance in price."""
    bad = raw.filter("tick_size IS NULL OR tick_size <= 0 OR contract_size <= 0 OR volume_step <= 0 OR volume_min > volume_max")
    if bad.limit(1).count():
        raise ValueError(f"unusable instruments, such as {bad.first().symbol}")
    unit = F.col("tick_value") / F.col("tick_size")
    return raw.withColumns({"value_per_unit": unit, "pip_value": unit * F.col("pip_size"), "stop_distance": F.coalesce(F.col("stop_level") * F.col("point"), F.lit(0.0))})
