"""Wide frames with a column for each timeframe and field, exact rows, checks at boundaries, and stores of features and news."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sandpiper.sources.candles import KEY, MINUTES, timeframes

FIELDS = ("open", "high", "low", "close", "volume")
NEWS = "time_utc timestamp_ntz, currency string, impact string, title string, before_min int, after_min int"


def timeframe_columns(columns: list[str]) -> dict[str, dict[str, str]]:
    """For every timeframe that the column names carry (``H4_close``) its columns by field, shortest timeframe first."""
    found: dict[str, dict[str, str]] = {}
    for c in columns:
        m = re.fullmatch(rf"({'|'.join(MINUTES)})_({'|'.join(FIELDS)})", c)
        if m:
            found.setdefault(m[1], {})[m[2]] = c
    return {tf: found[tf] for tf in timeframes(found)}


def of_timeframe(df: DataFrame, tf: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The keys and one timeframe's fields under their plain names, without rows where all of these are null."""
    own = timeframe_columns(df.columns).get(tf)
    if not own:
        raise ValueError(f"no columns of {tf}")
    return df.select(*keys, *(F.col(c).alias(f) for f, c in own.items())).dropna("all", subset=list(own))


def finite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Doubles and floats with NaN and infinities as null, as floats."""
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).cast("float") for c in names}) if names else df


def first_filled(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column that exists and has a value; one pass over the table."""
    have = [c for c in candidates if c in df.columns]
    counts = df.agg(*(F.count(c).alias(c) for c in have)).first() if have else None
    return next((c for c in have if counts[c]), None)


def row_at(df: DataFrame, ts: str, by: str = "symbol") -> DataFrame:
    """The one row of every series at an exact time; a series with none or several there is an error."""
    at = F.lit(ts).cast("timestamp_ntz")
    counts = df.groupBy(by).agg(F.count_if(F.col("ts") == at).alias("__n"))
    checked = counts.select(by, F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.col("__n").cast("string"), F.lit(" rows at that time for "), F.col(by)))).alias("__ok"))
    return df.filter(F.col("ts") == at).join(checked, by, "right").filter("__ok").drop("__ok")


def at_or_before(df: DataFrame, asked: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """For every (by, at) asked the last value that isn't null at or before ``at``, the last of all where ``at`` is null. One union and one window."""
    kind = asked.schema["at"].dataType
    known = df.filter(F.col(value).isNotNull()).select(by, F.col("ts").cast(kind).alias("__t"), value)
    wanted = asked.select(by, F.coalesce("at", F.lit("9999-12-31").cast(kind)).alias("__t"), "at", F.lit(True).alias("__asked"))
    line = Window.partitionBy(by).orderBy(F.col("__t"), F.col("__asked").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(wanted, allowMissingColumns=True).withColumn(value, F.last(value, True).over(line))
    return both.filter("__asked").select(by, "at", value)


def check_dataset(df: DataFrame, symbol: str, tfs: list[str]) -> DataFrame:
    """The candles, if they are of one symbol and have just these timeframes; else a ValueError names what differs."""
    have = df.select(*KEY).distinct().limit(2 * len(MINUTES)).collect()
    symbols, found = sorted({r.symbol for r in have}), timeframes({r.tf for r in have})
    if symbols != [symbol]:
        raise ValueError(f"symbol: {symbol!r} expected, {symbols} found")
    if found != timeframes(tfs):
        raise ValueError(f"timeframes: {timeframes(tfs)} expected, {found} found")
    return df


def save_features(features: DataFrame, metadata: DataFrame, path: str, kind: str = "parquet") -> None:
    """Features partitioned by timeframe under path/data, their metadata beside them under path/meta, as Parquet or CSV."""
    if kind not in ("parquet", "csv"):
        raise ValueError("parquet or csv")
    for frame, part in ((features, "data"), (metadata, "meta")):
        frame.write.mode("overwrite").partitionBy("tf").option("header", True).format(kind).save(f"{path}/{part}")


def read_features(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """What save_features() wrote: features and metadata."""
    return tuple(spark.read.option("header", True).option("inferSchema", True).format(kind).load(f"{path}/{part}") for part in ("data", "meta"))


def save_news(news: DataFrame, path: str) -> None:
    news.write.mode("overwrite").parquet(path)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """A stored news table; an empty one where there is none."""
    try:
        return spark.read.schema(NEWS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], NEWS)


def moment(value, zone: str | None, out: str | None = None) -> dt.datetime | None:
    """A moment from a datetime, a date, seconds since 1970, an ISO string or ``now``; None and blanks give None.

    What has no zone of its own is in ``zone``; the result is in ``out``, which may be left out only for those.
    """
    if value is None or value == "":
        return None
    try:
        here, there = (ZoneInfo(z) if z else None for z in (zone, out or zone))
    except ZoneInfoNotFoundError as e:
        raise ValueError(f"unknown zone: {e}") from e
    if isinstance(value, bool) or not isinstance(value, (dt.date, int, float, str)):
        raise TypeError(f"not a moment: {value!r}")
    if isinstance(value, str):
        text = value.strip()
        value = dt.datetime.now(here) if text.lower() == "now" and here else dt.datetime.fromisoformat(text)
    elif isinstance(value, (int, float)):
        value = dt.datetime.fromtimestamp(value, dt.UTC)
        out = out or zone
    elif not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    if value.tzinfo is None:
        if here is None:
            raise ValueError("a zone is needed for a time without one")
        value = value.replace(tzinfo=here)
    elif out is None and not (here and value.tzinfo == here):
        raise ValueError("a zone to give the result in is needed")
    return value.astimezone(there)
