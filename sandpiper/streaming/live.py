"""Live candles on Structured Streaming: new-bar detection, rolling caches and incremental indicators, with state by series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sandpiper.operators.structure import advance
from sandpiper.plans.features import features, plan, warmup
from sandpiper.session import remove, ship, written
from sandpiper.sources.candles import KEY, MINUTES, last_rows, timeframe, upsert


def live_candles(ticks: DataFrame, tf: str, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, id, price); a bar is given once the watermark has passed its end."""
    tf = timeframe(tf)
    order = F.struct("ts", "id")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", bucket_length(tf)).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"),
    )
    return bars.select("symbol", F.lit(tf).alias("tf"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def bucket_length(tf: str) -> str:
    return f"{MINUTES[tf]} minutes"


def detect_new(bars: DataFrame) -> DataFrame:
    """Rows newer than any of their series so far; the first row arms the detector only, older and equal ones are ignored."""
    ship(bars.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for row in rows.itertuples(index=False):
            if last is not None and row.ts > last:
                out.append((key[0], key[1], row.ts, row.close))
            last = row.ts if last is None else max(last, row.ts)
        state.update((str(last),))
        yield pd.DataFrame(out, columns=["symbol", "tf", "ts", "close"]).astype({"ts": "datetime64[ns]", "close": "float64"})

    return bars.select(*KEY, "ts", "close").groupBy(*KEY).applyInPandasWithState(run, "symbol string, tf string, ts timestamp, close double", "last string", "append", GroupStateTimeout.NoTimeout)


def live_ema(bars: DataFrame, period: int) -> DataFrame:
    """The EMA of each new closed bar, equal to the batch one: (last time, value, count) is kept for every series."""
    ship(bars.sparkSession)
    alpha = 2 / (period + 1)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last, value, n = state.get if state.exists else ("", 0.0, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            if last and row.ts <= pd.Timestamp(last):
                continue
            value = row.close if n == 0 else alpha * row.close + (1 - alpha) * value
            n, last = n + 1, str(row.ts)
            out.append((key[0], key[1], row.ts, value if n >= period else None))
        state.update((last, value, n))
        yield pd.DataFrame(out, columns=["symbol", "tf", "ts", "ema"]).astype({"ts": "datetime64[ns]", "ema": "float64"})

    return bars.select(*KEY, "ts", "close").groupBy(*KEY).applyInPandasWithState(run, "symbol string, tf string, ts timestamp, ema double", "last string, value double, n long", "append", GroupStateTimeout.NoTimeout)


def live_swings(bars: DataFrame, reversal: float = 0.01, least: int = 1, by_close: bool = False) -> DataFrame:
    """Swings of new closed bars as causal_swings() gives them: ts of the confirming bar, cs, cs_price, cs_age; the machine's state is kept for every series."""
    ship(bars.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last, machine = (state.get[0], tuple(state.get[1:])) if state.exists else ("", None)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            if last and row.ts <= pd.Timestamp(last):
                continue
            machine, found = advance(machine, row.high, row.low, row.close, reversal, least, by_close)
            last = str(row.ts)
            if found is not None:
                out.append((*key, row.ts, float(found[0]), float(found[1]), float(machine[0] - found[2])))
        state.update((last, *machine))
        yield pd.DataFrame(out, columns=["symbol", "tf", "ts", "cs", "cs_price", "cs_age"]).astype({"ts": "datetime64[ns]", "cs": "float64", "cs_price": "float64", "cs_age": "float64"})

    kept = "last string, place long, seek int, extreme double, at long, swing long, high double, low double, close double"
    return bars.select(*KEY, "ts", "high", "low", "close").groupBy(*KEY).applyInPandasWithState(run, "symbol string, tf string, ts timestamp, cs double, cs_price double, cs_age double", kept, "append", GroupStateTimeout.NoTimeout)


def update_cache(cache: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """A series' newest ``keep`` rows after new ones replaced or joined the old (for foreachBatch)."""
    return last_rows(upsert(cache, new), keep)


class LiveFeatures:
    """Features of live bars from a rolling cache, for foreachBatch: every named feature, as in the batch engine.

    The cache keeps each series' newest bars, ``keep`` times the longest warm-up, in a folder that driver and executors share. A
    batch's bars replace or join it, features are computed over it, and only rows newer than their series' last are handed on.
    Window indicators equal the batch ones; recursive ones differ by what is older than the cache.

    A batch's cache is written under its number and made from that of the newest finished batch before it, so a restart goes on
    where the stream stood, and a batch that is run again writes and hands on the same. Older caches are removed.
    """

    def __init__(self, folder: str, specs: list[str], tf: str, emit, keep: int = 10):
        self.specs, self.tf, self.emit, self.folder = specs, timeframe(tf), emit, folder.rstrip("/")
        self.rows = keep * max(warmup(plan(specs, tf)).values())

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, fresh = batch.sparkSession, batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        done = sorted(n for n in map(int, written(spark, self.folder)) if n < batch_id)
        old = spark.read.parquet(f"{self.folder}/{done[-1]}") if done else None
        now = f"{self.folder}/{batch_id}"
        (fresh if old is None else update_cache(old, fresh, self.rows)).write.mode("overwrite").parquet(now)
        out = features({self.tf: spark.read.parquet(now)}, self.specs, self.tf)[self.tf]
        if old is not None:
            seen = old.groupBy(*KEY).agg(F.max("ts").alias("__seen"))
            out = out.join(seen, list(KEY), "left").filter("__seen IS NULL OR ts > __seen").drop("__seen")
        self.emit(out)
        for n in done[:-1]:
            remove(spark, f"{self.folder}/{n}")
