import datetime as dt

import pytest
from pyspark.sql import functions as F

from sandpiper.operators.recursive import ema
from sandpiper.plans.features import features
from sandpiper.streaming.live import LiveFeatures, detect_new, live_candles, live_ema, update_cache

from .test_candles import bars


def run(spark, df, mode="append"):
    name = f"out{abs(hash(str(df.schema)))}{dt.datetime.now().microsecond}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_live_ema_is_the_batch_one(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    b = bars(spark, 40)
    rows = sorted(b.collect(), key=lambda r: r.ts)
    path = str(tmp_path / "in")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, b.schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume long").option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.symbol, r.ts): r.ema for r in run(spark, live_ema(stream, 6))}
    want = {(r.symbol, r.ts): r.ema for r in ema(b, period=6).collect()}
    assert len(got) == 80
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None or got[k] != got[k] for k, v in want.items())
    seen = run(spark, detect_new(stream))
    assert len(seen) == 78  # the first row of each series arms the detector only


def test_live_candles_and_cache(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("A", t + dt.timedelta(minutes=7 * k), k, float(k)) for k in range(60)], "symbol string, ts timestamp, id long, price double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    done = run(spark, live_candles(stream, "H1"))
    assert done and all(r.low <= r.open <= r.high and r.volume in (8, 9) for r in done)
    b = bars(spark, 30)
    kept = update_cache(b, b.filter("ts >= '2024-01-02'"), 10).collect()
    assert len(kept) == 20 and min(r.ts for r in kept) == dt.datetime(2024, 1, 1, 20)


def test_live_features_equal_the_batch(spark, tmp_path):
    b = bars(spark, 60)
    rows = sorted(b.collect(), key=lambda r: r.ts)
    seen = []
    live = LiveFeatures(str(tmp_path / "cache"), ["sma(close,5)", "donchian(n=6)"], "H1", lambda df: seen.extend(df.collect()))
    for k, part in enumerate((rows[:50], rows[50:51], rows[51:])):
        live(spark.createDataFrame(part, b.schema), k)
    want = features({"H1": b}, ["sma(close,5)", "donchian(n=6)"], "H1")["H1"].collect()
    key = lambda r: (r.symbol, r.ts)
    assert len(seen) == 120
    by = {key(r): r for r in want}
    assert all(tuple(r) == tuple(by[key(r)]) for r in seen)


def test_a_restart_goes_on_and_a_replay_gives_the_same(spark, tmp_path):
    b = bars(spark, 60)
    rows = sorted(b.collect(), key=lambda r: r.ts)
    parts = [spark.createDataFrame(p, b.schema) for p in (rows[:60], rows[60:90], rows[90:])]
    out = {}

    def live(k):
        LiveFeatures(str(tmp_path / "cache"), ["sma(close,5)"], "H1", lambda df: out.setdefault(k, []).append(sorted(map(tuple, df.collect()))))(parts[k], k)

    for k in (0, 1, 1, 2):  # each from a new object, the second batch twice
        live(k)
    assert out[1][0] == out[1][1] and len(out[1][0]) == 30
    want = features({"H1": b}, ["sma(close,5)"], "H1")["H1"].collect()
    assert sorted(out[0][0] + out[1][0] + out[2][0]) == sorted(map(tuple, want))
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["1", "2"]
