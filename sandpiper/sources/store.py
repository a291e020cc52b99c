"""A feature store that grows: new bars replace or join the partitions they fall into, new features join by column."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sandpiper.operators.joins import asof
from sandpiper.session import cut
from sandpiper.sources.candles import KEY, MINUTES, span

PARTITION = ("tf", "month")
ROW = (*KEY, "ts")


def _month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("ts", "yyyy-MM"))


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored features; None where there is no store yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append_features(features: DataFrame, path: str) -> None:
    """Write features by timeframe and month. A stored row with the same (symbol, tf, ts) is replaced; partitions that the new rows don't
    fall into are neither read nor written. Columns that only one side has are null on the other. Of new rows with one key one stays.
    """
    spark = features.sparkSession
    one = Window.partitionBy(*ROW).orderBy(*(F.col(c) for c in sorted(set(features.columns) - set(ROW))))
    new = _month(features).withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")
    old = read_store(spark, path)
    if old is not None:
        touched = F.broadcast(new.select(*PARTITION).distinct())  # a row for each month and timeframe
        stay = old.withColumn("month", F.col("month").cast("string")).join(touched, list(PARTITION), "left_semi").join(new.select(*ROW), list(ROW), "left_anti")
        new = cut(stay.unionByName(new, allowMissingColumns=True))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)


def merge_columns(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rows of both sides by (symbol, tf, ts), with the columns of both.

    A column that both have is merged if its values agree wherever both sides have the row (numbers within ``tolerance``, null equals null);
    if not, a ValueError names every column that differs and how often.
    """
    shared = sorted(set(left.columns) & set(right.columns) - set(ROW))
    kinds = dict(left.dtypes)
    both = left.withColumn("__left", F.lit(True)).join(right.withColumnsRenamed({c: f"__r_{c}" for c in shared}).withColumn("__right", F.lit(True)), list(ROW), "full")

    def same(c: str):
        a, b = F.col(c), F.col(f"__r_{c}")
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) if kinds[c] in ("double", "float") and tolerance else a.eqNullSafe(b)

    if shared:
        met = both.filter("__left AND __right")
        counts = met.agg(*(F.count_if(~same(c)).alias(c) for c in shared)).first()
        if differ := {c: counts[c] for c in shared if counts[c]}:
            raise ValueError("columns differ: " + ", ".join(f"{c} in {n} rows" for c, n in differ.items()))
    out = both.withColumns({c: F.when(F.col("__left"), F.col(c)).otherwise(F.col(f"__r_{c}")) for c in shared}) if shared else both
    return out.drop("__left", "__right", *(f"__r_{c}" for c in shared))


def missing_ranges(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """(symbol, tf, start, end): what of the wanted ranges (symbol, tf, start, end; end not included) has no stored bar.

    A range is cut wherever two neighbouring bars are further apart than their timeframe; one without any bar comes back whole. Bars
    and wanted ranges meet by symbol and timeframe, neighbours in one ordered window for each range.
    """
    asked = wanted.filter("start < end").select(*KEY, F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end")).distinct()
    step = _step()
    inside = bars.select(*KEY, F.col("ts").cast("timestamp_ntz").alias("at")).distinct().join(asked, list(KEY)).filter("at >= start AND at < end")
    edges = asked.withColumn("at", F.explode(F.array(F.col("start") - step, F.col("end"))))
    line = Window.partitionBy(*KEY, "start", "end").orderBy("at")
    rows = inside.unionByName(edges).distinct().withColumn("next", F.lead("at").over(line))
    gaps = rows.filter(F.col("next") > F.col("at") + step)
    return gaps.select(*KEY, (F.col("at") + step).alias("start"), F.col("next").alias("end"))


def _step():
    """How long a bar of the row's timeframe lasts."""
    minutes = F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair))
    return F.make_dt_interval(mins=minutes[F.col("tf")])


def observation_grid(bars: DataFrame, tf: str, columns: list[str], out_of: list[tuple[int, int]] | None = None, weekends: bool = True) -> DataFrame:
    """A row for every time of the grid from a symbol's first bar to its last, with the newest values at or before it, and filled: 1 where no bar is at that time.

    out_of: hours of the day (from, up to) that belong to no session and are left out; weekends are left out unless wanted.
    """
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    times = spans.select("symbol", F.explode(F.sequence("a", "b", F.expr(span(tf)))).alias("at"))
    for a, b in out_of or []:
        times = times.filter(~F.hour("at").between(a, b - 1))
    if not weekends:
        times = times.filter(F.dayofweek("at").between(2, 6))
    known = bars.select("symbol", F.col("ts").alias("at"), F.col("ts").alias("__ts"), *columns)
    out = asof(times, known, "symbol")
    return out.select("symbol", F.lit(tf).alias("tf"), F.col("at").alias("ts"), *columns, (F.col("__ts") != F.col("at")).cast("int").alias("filled"))
