"""Candles: from ticks, from files, and back; readiness, upsert and metadata.

A candle row is (symbol, tf, ts, open, high, low, close, volume), ts being the open time. Candles of one symbol and timeframe
are bounded by the calendar (525,600 one-minute bars a year), however many ticks they come from; ticks are reduced by a
grouped aggregate with partial sums, so a symbol with a third of all ticks needs no salting.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Minutes of each timeframe code; a month counts as 30 days. Fixed values.
MINUTES = {
    "M1": 1, "M2": 2, "M3": 3, "M4": 4, "M5": 5, "M6": 6, "M10": 10, "M12": 12, "M15": 15, "M20": 20, "M30": 30,
    "H1": 60, "H2": 120, "H3": 180, "H4": 240, "H6": 360, "H8": 480, "H12": 720, "D1": 1440, "W1": 10080, "MN1": 43200,
}
SCHEMA = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, spread bigint"
KEY = ("symbol", "tf")


def series(*more: str):
    """Rows of one series in time order."""
    return Window.partitionBy(*KEY).orderBy("ts", *more)


def timeframe(code: str) -> str:
    """The canonical code; case and the spellings 1m, 1h, 4h, 1d, 1w, 1mo are understood."""
    code = str(code).strip().upper()
    if code in MINUTES:
        return code
    number, unit = code.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), code.lstrip("0123456789")
    unit = {"M": "M", "MIN": "M", "T": "M", "H": "H", "D": "D", "W": "W", "MO": "MN", "MN": "MN"}.get(unit, unit)
    if unit + number not in MINUTES:
        raise ValueError(f"unknown timeframe {code!r}")
    return unit + number


def timeframes(codes: Iterable[str]) -> list[str]:
    """Canonical, distinct, by rising length."""
    return sorted({timeframe(c) for c in codes}, key=MINUTES.__getitem__)


def span(tf: str) -> str:
    return f"INTERVAL {MINUTES[tf]} MINUTE"


def bucket(ts: Column, tf: str) -> Column:
    """The open time of the bar of a timestamp; bars count from 1970-01-01 (weeks from a Monday)."""
    shift = "4 days" if tf == "W1" else None
    return F.window(ts, f"{MINUTES[tf]} minutes", None, shift)["start"]


def candles(ticks: DataFrame, tf: str) -> DataFrame:
    """Bars of ticks (symbol, ts, id, price): ties of ts go by id. Ticks without ts or price are left out."""
    tf = timeframe(tf)
    order = F.struct("ts", "id")
    rows = ticks.filter("ts IS NOT NULL AND price IS NOT NULL")
    bars = rows.groupBy("symbol", bucket(F.col("ts"), tf).alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count("*").alias("volume"),
    )
    return bars.select("symbol", F.lit(tf).alias("tf"), F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Longer bars from shorter ones."""
    tf = timeframe(tf)
    out = bars.groupBy("symbol", bucket(F.col("ts"), tf).alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select("symbol", F.lit(tf).alias("tf"), F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def normalise(raw: DataFrame, order: str = "seq") -> DataFrame:
    """Canonical columns with numbers coerced (bad ones null); of rows with one key the last by ``order`` stays."""
    cols = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close")]
    cols += [F.expr(f"try_cast({c} AS BIGINT)").alias(c) if c in raw.columns else F.lit(None).cast("bigint").alias(c) for c in ("volume", "spread")]
    latest = Window.partitionBy(*KEY, "ts").orderBy(F.desc(order))
    rows = raw.select(*KEY, "ts", *cols, order).filter("ts IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").drop("nth", order)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with new ones over them, by (symbol, tf, ts)."""
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*KEY, "ts").orderBy(F.desc("seq"))
    return both.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").drop("nth", "seq")


def last_rows(bars: DataFrame, start: int, end: int = 0) -> DataFrame:
    """The last ``start`` rows of every series without the last ``end``."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("ts"))
    return bars.withColumn("nth", F.row_number().over(newest)).filter((F.col("nth") <= start) & (F.col("nth") > end)).drop("nth")


def between(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from start up to, without, end; either may be open."""
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if end is None else bars.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def metadata(bars: DataFrame) -> DataFrame:
    """Rows, first and last time of every series."""
    return bars.groupBy(*KEY).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def readiness(bars: DataFrame, required: DataFrame) -> DataFrame:
    """For (symbol, tf, bars needed): missing, insufficient or ready."""
    have = required.join(metadata(bars), list(KEY), "left")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") < F.col("needed"), "insufficient").otherwise("ready")
    return have.select(*KEY, "needed", F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("status"))


def feature_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """For every column of every tf: first time with a value, rows without a finite one, and the share with one."""
    parts = []
    for c in columns:
        finite = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        parts.append(F.struct(F.lit(c).alias("column"), F.min(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col("ts"))).alias("first_valid_ts"), F.count_if(~finite).alias("nan_count"), (F.count_if(finite) / F.count("*")).alias("coverage_ratio")))
    return df.groupBy("tf").agg(F.array(*parts).alias("m")).select("tf", F.explode("m").alias("m")).select("tf", "m.*")


def write(bars: DataFrame, path: str) -> None:
    """A table partitioned by symbol and tf, so that scans of one series read only its files."""
    bars.write.mode("overwrite").partitionBy(*KEY).parquet(path)


def read(spark: SparkSession, path: str, symbols: list[str] | None = None, tfs: list[str] | None = None) -> DataFrame:
    """A stored table; a timeframe that is asked for and not there is an error."""
    bars = spark.read.parquet(path)
    if symbols:
        bars = bars.filter(F.col("symbol").isin(symbols))
    if tfs:
        wanted = timeframes(tfs)
        bars = bars.filter(F.col("tf").isin(wanted))
        if missing := set(wanted) - {r.tf for r in bars.select("tf").distinct().collect()}:
            raise FileNotFoundError(f"no candles for {sorted(missing)}")
    return bars


def read_csv(spark: SparkSession, path: str, symbol: str, tf: str, zone: str = "UTC") -> DataFrame:
    """Candles from a CSV with a header; time is local to ``zone`` and becomes UTC; tick_volume stands in for volume."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    if "volume" not in names and "tick_volume" in names:
        names["volume"] = names["tick_volume"]
    time = F.to_utc_timestamp(F.to_timestamp(names.get("time", names.get("timestamp"))), zone).cast("timestamp_ntz")
    cols = [F.col(names[c]).alias(c) for c in ("open", "high", "low", "close", "volume", "spread") if c in names]
    return normalise(raw.select(F.lit(symbol).alias("symbol"), F.lit(timeframe(tf)).alias("tf"), time.alias("ts"), *cols, F.monotonically_increasing_id().alias("seq")))


def grid(start: Column, end: Column, tf: str) -> Column:
    """The bar times from start's bar to end's."""
    floor = lambda c: F.date_trunc("day", c) if tf == "D1" else F.expr("TIMESTAMP_NTZ '1970-01-01'") + F.make_dt_interval(mins=(F.floor((F.unix_timestamp(c.cast("timestamp")) / 60) / MINUTES[tf]) * MINUTES[tf]).cast("int"))
    return F.sequence(floor(start).cast("timestamp_ntz"), floor(end).cast("timestamp_ntz"), F.expr(span(tf)))
