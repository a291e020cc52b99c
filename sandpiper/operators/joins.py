"""Joins in time: as-of, with lags, exact, by interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.sources.candles import MINUTES, series, span


def asof(left: DataFrame, right: DataFrame, on: str, time: str = "at", columns: list[str] | None = None) -> DataFrame:
    """Every left row with the newest right row at or before its ``time`` (equal times match), by ``on``; null where none.

    Both sides go into one ordered window, so there is one shuffle on ``on`` and no row meets more than its own.
    """
    columns = columns or [c for c in right.columns if c not in (on, time)]
    a = left.select(on, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__new"))
    b = right.select(on, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(*columns).alias("__new"))
    order = Window.partitionBy(on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__new", F.last("__new", True).over(order)).filter("__side = 1")
    return both.select("__row.*", *(F.col(f"__new.{c}").alias(c) for c in columns))


def close_time(bars: DataFrame, tf: str, name: str = "at") -> DataFrame:
    return bars.withColumn(name, F.col("ts") + F.expr(span(tf)))


def align(base: DataFrame, base_tf: str, others: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Base rows with ``columns`` of longer bars as <TF>_<column>: only bars that have closed when the base bar closes."""
    out = close_time(base, base_tf)
    for tf in sorted(others, key=MINUTES.__getitem__):
        renamed = close_time(others[tf], tf).select("symbol", "at", *(F.col(c).alias(f"{tf}_{c}") for c in columns))
        out = asof(out, renamed, "symbol")
    return out.drop("at")


def candle_lags(index: DataFrame, bars: DataFrame, tf: str, names: list[str], depth: int) -> DataFrame:
    """For every (symbol, ts) of index the ``depth`` newest bars that have closed by ts: <TF>_lag<k>_<name>."""
    lags = {f"{tf}_lag{k}_{n}": F.lag(n, k).over(series()) for k in range(depth) for n in names}
    closed = close_time(bars, tf).withColumns(lags).select("symbol", "at", *lags)
    return asof(index.withColumn("at", F.col("ts")), closed, "symbol").drop("at")


def exact_quotes(index: DataFrame, bars: DataFrame, point: float, strict: bool = True) -> DataFrame:
    """bid and ask at exactly each time: close, and close plus spread points. A time without a bar is an error (or null, if not strict)."""
    quotes = bars.select("symbol", "ts", F.col("close").alias("bid"), (F.col("close") + F.coalesce("spread", F.lit(0)) * point).alias("ask"))
    out = index.join(quotes, ["symbol", "ts"], "left")
    if not strict:
        return out
    found = F.coalesce("bid", F.raise_error(F.concat(F.lit("no quote for "), F.col("symbol"), F.lit(" at "), F.col("ts").cast("string"))).cast("double"))
    return out.withColumn("bid", found)


def positional(base: DataFrame, higher: DataFrame, column: str, out: str) -> DataFrame:
    """The higher series spread evenly over the base rows by position, not by time; the last value fills the rest."""
    n, m = base.groupBy("symbol").count(), higher.groupBy("symbol").agg(F.count("*").alias("m"))
    step = n.join(m, "symbol").select("symbol", "m", F.greatest(F.lit(1), F.floor(F.col("count") / F.col("m"))).alias("step"))
    order = Window.partitionBy("symbol").orderBy("ts")
    a = base.withColumn("__n", F.row_number().over(order) - 1).join(step, "symbol").withColumn("__k", F.least(F.floor(F.col("__n") / F.col("step")), F.col("m") - 1))
    b = higher.select("symbol", (F.row_number().over(order) - 1).cast("long").alias("__k"), F.col(column).alias(out))
    return a.join(b, ["symbol", "__k"], "left").drop("__n", "__k", "m", "step")


def same_timeline(bars: DataFrame) -> DataFrame:
    """Times that not every symbol has."""
    symbols = bars.agg(F.count_distinct("symbol").alias("all"))
    return bars.groupBy("ts").agg(F.count_distinct("symbol").alias("n")).join(F.broadcast(symbols), F.col("n") < F.col("all")).select("ts", "n")


def news_gate(bars: DataFrame, news: DataFrame, currencies: DataFrame) -> DataFrame:
    """freeze, reduce and the titles for bars inside a news event's own window, by the currencies of their symbol.

    news: (time_utc, currency, impact, title, before_min, after_min); currencies: (symbol, currency). High impact freezes,
    medium reduces. Events are cut into the hours they cover and joined on currency and hour, then on the exact window,
    so the join has an equality to shuffle on whatever the number of events.
    """
    windows = news.withColumns({"a": F.col("time_utc") - F.make_dt_interval(mins=F.col("before_min")), "b": F.col("time_utc") + F.make_dt_interval(mins=F.col("after_min"))})
    hours = windows.withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", "a").cast("timestamp_ntz"), F.date_trunc("hour", "b").cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR")))).select("currency", "hour", "a", "b", "impact", "title")
    keyed = bars.select("symbol", "ts").join(currencies, "symbol").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    hits = keyed.join(hours, ["currency", "hour"]).filter("ts BETWEEN a AND b")
    found = hits.groupBy("symbol", "ts").agg(F.max(F.when(F.col("impact") == "high", 1).otherwise(0)).alias("f"), F.max(F.when(F.col("impact") == "medium", 1).otherwise(0)).alias("r"), F.array_join(F.array_sort(F.collect_set("title")), ";").alias("titles"))
    out = bars.join(found, ["symbol", "ts"], "left")
    return out.withColumns({"freeze": F.coalesce("f", F.lit(0)), "reduce": F.when(F.coalesce("f", F.lit(0)) == 1, 0).otherwise(F.coalesce("r", F.lit(0)))}).drop("f", "r")


#: Fixed words for the impact of an event.
IMPACTS = {"high": ("high", "red", "3"), "medium": ("medium", "med", "orange", "2"), "low": ("low", "yellow", "1", "holiday", "none")}


def normalise_news(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Date, time, currency, impact and event as text become time_utc, currency, impact, title, before_min, after_min.

    ``All Day``, ``Tentative`` and no time mean midnight; an unknown impact is low; rows without a date are left out; of
    repeated (time, currency, title) the first by seq stays.
    """
    clock = F.when(F.lower(F.trim("time")).isin("all day", "tentative", "") | F.col("time").isNull(), "00:00").otherwise(F.trim("time"))
    local = F.try_to_timestamp(F.concat_ws(" ", F.trim("date"), clock), F.lit("yyyy-MM-dd HH:mm"))
    word = F.lower(F.trim("impact"))
    impact = F.lit("low")
    for name, words in IMPACTS.items():
        impact = F.when(word.isin(*words), name).otherwise(impact)
    rows = raw.select(F.to_utc_timestamp(local, zone).cast("timestamp_ntz").alias("time_utc"), F.upper(F.trim("currency")).alias("currency"), impact.alias("impact"), F.trim("event").alias("title"), "seq").filter("time_utc IS NOT NULL")
    first = Window.partitionBy("time_utc", "currency", "title").orderBy("seq")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "seq")
    before = F.when(F.col("impact") == "high", 30).when(F.col("impact") == "medium", 15).otherwise(0)
    return rows.withColumns({"before_min": before, "after_min": F.when(F.col("impact") != "low", 15).otherwise(0)})
