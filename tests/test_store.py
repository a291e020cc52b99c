"""The growing feature store, coverage of ranges, observation grids, rolling quantiles, nearest levels and the ledger."""

import datetime as dt
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandpiper.operators.levels import nearest_cluster
from sandpiper.operators.recursive import rolling_quantiles
from sandpiper.sources.store import append_features, merge_columns, missing_ranges, observation_grid, read_store
from sandpiper.streaming.ledger import Ledger, booked_once
from sandpiper.streaming.ordered import STORE

from .test_candles import bars


def rows(df, names=("symbol", "ts", "close")):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_a_store_that_grows(spark, tmp_path):
    path, all_bars = str(tmp_path / "store"), bars(spark, 24 * 70).drop("open", "high", "low")
    assert read_store(spark, path) is None
    march = dt.datetime(2024, 3, 1)
    append_features(all_bars.filter(F.col("ts") < F.lit(march)), path)
    january = f"{path}/tf=H1/month=2024-01"
    before = {f: os.path.getmtime(f"{january}/{f}") for f in os.listdir(january)}
    append_features(all_bars.filter(F.col("ts") >= F.lit(march - dt.timedelta(days=2))), path)  # two days come again
    assert rows(read_store(spark, path)) == rows(all_bars)
    assert before == {f: os.path.getmtime(f"{january}/{f}") for f in os.listdir(january)}  # not rewritten
    append_features(all_bars.filter(F.col("ts") >= F.lit(march)).withColumns({"close": F.col("close") + 1, "more": F.lit(2.0)}), path)
    got = read_store(spark, path)
    assert rows(got) == rows(all_bars.withColumn("close", F.when(F.col("ts") >= F.lit(march), F.col("close") + 1).otherwise(F.col("close"))))
    assert got.filter("more IS NULL").count() == all_bars.filter(F.col("ts") < F.lit(march)).count()
    append_features(all_bars.limit(0), path)
    assert got.count() == all_bars.count()


def test_columns_merge_if_their_values_agree(spark):
    b = bars(spark, 20)
    left, right = b.select("symbol", "tf", "ts", "close", "high"), b.filter("ts > '2024-01-01 05:00'").select("symbol", "tf", "ts", "close", "low")
    got = merge_columns(left, right)
    assert set(got.columns) == {"symbol", "tf", "ts", "close", "high", "low"} and rows(got) == rows(b) and got.filter("low IS NULL").count() == 12
    with pytest.raises(ValueError, match="columns differ: close in 3 rows"):
        merge_columns(left, right.withColumn("close", F.when(F.hour("ts").isin(7, 8, 9) & (F.col("symbol") == "A"), None).otherwise(F.col("close"))))
    near = right.withColumn("close", F.col("close") + 1e-12)
    assert rows(merge_columns(left, near, 1e-9)) == rows(b)
    with pytest.raises(ValueError, match="close in 28 rows"):
        merge_columns(left, near)


def test_missing_ranges_against_a_loop(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    have = {(s, start + dt.timedelta(hours=h)) for s in "AB" for h in range(100) if rng.random() < 0.8 and not 40 < h < 55}
    stored = spark.createDataFrame([(s, "H1", t) for s, t in have] * 2, "symbol string, tf string, ts timestamp_ntz")
    wanted = [("A", 0, 100), ("A", 30, 60), ("B", 41, 54), ("B", 60, 60), ("C", 3, 9)]
    got = missing_ranges(stored, spark.createDataFrame([(s, "H1", start + dt.timedelta(hours=a), start + dt.timedelta(hours=b)) for s, a, b in wanted], "symbol string, tf string, start timestamp_ntz, end timestamp_ntz"))
    want = []
    for s, a, b in wanted:
        hours = [h for h in range(a, b) if (s, start + dt.timedelta(hours=h)) not in have]
        runs = [h for h in hours if h - 1 not in hours]
        for h in runs:
            end = h
            while end in hours:
                end += 1
            want.append((s, start + dt.timedelta(hours=h), start + dt.timedelta(hours=end)))
    assert sorted((r.symbol, r.start, r.end) for r in got.collect()) == sorted(want) and len(want) > 20


def test_a_grid_over_sparse_bars(spark):
    t = dt.datetime(2024, 1, 5, 20)  # a Friday
    at = [0, 1, 5, 80]
    b = spark.createDataFrame([("A", "H1", t + dt.timedelta(hours=h), float(h)) for h in at], "symbol string, tf string, ts timestamp_ntz, close double")
    got = observation_grid(b, "H1", ["close"]).orderBy("ts").collect()
    assert [r.close for r in got] == [float(max(h for h in at if h <= k)) for k in range(81)] and [r.filled for r in got] == [int(k not in at) for k in range(81)]
    some = observation_grid(b, "H1", ["close"], out_of=[(0, 6)], weekends=False).collect()
    assert {r.ts for r in some} == {r.ts for r in got if r.ts.hour >= 6 and r.ts.weekday() < 5}


def test_rolling_quantiles_against_numpy_and_in_linear_time(spark):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.1 else float(rng.integers(0, 20)) for _ in range(300)]
    df = spark.createDataFrame([("A", "H1", k, v) for k, v in enumerate(values)], "symbol string, tf string, ts int, x double")
    got = rolling_quantiles(df, "x", 25, {"lo": 0.25, "hi": 0.9}).orderBy("ts").collect()
    for k, r in enumerate(got):
        own = [v for v in values[max(0, k - 24) : k + 1] if v is not None]
        assert (r.lo, r.hi) == ((None, None) if not own else (pytest.approx(np.quantile(own, 0.25)), pytest.approx(np.quantile(own, 0.9))))
    long = spark.range(60_000).selectExpr("'A' symbol", "'H1' tf", "id ts", "rand(3) x").cache()
    long.count()
    took = []
    for n in (50, 2000):
        start = time.perf_counter()
        rolling_quantiles(long, "x", n, {"q": 0.5}).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    long.unpersist()
    assert took[1] < 4 * took[0] + 2  # 40 times the width


@pytest.mark.parametrize("length", ["3 HOURS", "1 DAY", "500 DAYS"])
def test_nearest_level_against_a_loop(spark, length):
    rng = random.Random(3)
    b = bars(spark, 80).withColumn("close", F.when(F.hour("ts") != 5, F.round("close")))
    found = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.uniform(-5, 80)), float(rng.randrange(85, 115)), float(rng.randrange(4))) for s in "AB" for _ in range(60)]
    clusters = spark.createDataFrame([(s, "H1", t, p, x) for s, t, p, x in found], "symbol string, tf string, known_ts timestamp_ntz, price double, score double")
    got = nearest_cluster(b, clusters, length=length).collect()
    assert len(got) == 160
    for r in got:
        best = min(((abs(r.close - p), p, x) for s, t, p, x in found if s == r.symbol and t <= r.ts), default=None) if r.close is not None else None
        assert (r.nearest_price, r.nearest_score) == (best[1:] if best else (None, None)), r
    assert nearest_cluster(b, clusters.limit(0), length=length).filter("nearest_price IS NOT NULL").count() == 0


def test_fills_are_booked_once(spark, tmp_path):
    schema, folder = "fill_id string, ts timestamp, cost double", str(tmp_path)
    t = dt.datetime(2024, 1, 1)
    make = lambda *fills: spark.createDataFrame([(i, t + dt.timedelta(minutes=m), c) for i, m, c in fills], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    make(("a", 1, 1.0), ("b", 2, 2.0), ("a", 0, 3.0), (None, 0, 9.0))
    make(("b", 5, 4.0), ("c", 6, 5.0))
    ledger = Ledger(f"{folder}/ledger")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    seen = {}

    def sink(batch, batch_id):
        ledger(batch, batch_id)
        ledger(batch, batch_id)  # as after a crash between writing and committing
        seen[batch_id] = True

    def go():
        fills = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = booked_once(fills).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)

    try:
        go()
        make(("c", 9, 6.0), ("d", 9, 7.0))
        go()  # a new query from the same checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(seen) == 3
    assert sorted((r.fill_id, r.cost) for r in ledger.entries(spark).collect()) == [("a", 3.0), ("b", 2.0), ("c", 5.0), ("d", 7.0)]
    assert sorted((r.fill_id or "", r.cost, r.times_seen) for r in ledger.rejects(spark).collect()) == [("", 9.0, 1), ("a", 1.0, 2), ("b", 4.0, 2), ("c", 6.0, 2)]
