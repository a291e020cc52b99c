"""Streams against the batch engine, over random cuts, late bars and restarts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandpiper.operators import joins, levels, patterns, rolling, structure
from sandpiper.plans.features import features, plan
from sandpiper.plans.registry import ALL
from sandpiper.sources.candles import resample
from sandpiper.streaming.indicators import LiveForm, live_indicators, validate_registry
from sandpiper.streaming.ordered import STORE
from sandpiper.streaming.registers import live_align, live_gap_register, live_level_breaks, live_liquidity_pools, live_zone_life

from .test_candles import bars

STREAM = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume long"
END = dt.datetime(2030, 1, 1)


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def feed(spark, folder, rows, schema=STREAM):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema=STREAM):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, folder):
    """What a stream has written once all that is there has been read; a second call goes on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.read.parquet(f"{folder}/out")


def shuffled(rows, seed, far):
    """Rows in an order of arrival in which none comes after one more than ``far`` newer."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: (r.ts + dt.timedelta(seconds=rng.random() * far.total_seconds()), r.symbol))


def same(got, want, names, key=("symbol", "ts")):
    """Equal rows and values, null for null."""
    pick = lambda rows: {tuple(str(r[k]) for k in key): [None if r[n] is None or r[n] != r[n] else float(r[n]) for n in names] for r in rows}
    got, want = pick(got), pick(want)
    assert got.keys() == want.keys() and len(want)
    for k, w in want.items():
        for n, a, b in zip(names, got[k], w, strict=True):
            assert (a is None) == (b is None), (k, n, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-8, abs=1e-8), (k, n)


SPECS = [f.name for f in ALL] + ["sma(high,7,min_periods=3)", "wma(close,5,min_periods=2)", "ema(low,9,min_periods=1)", "rsi(close,6,method=wilders)", "atr(9,method=classic)", "atr(9,method=ema)", "donchian(7)", "zscore(open,9)", "linreg_slope(high,6)", "kama(close,5,3,12)", "hma(close,9)", "cci(9,min_periods=4)"]


def test_every_entry_has_a_live_form():
    assert validate_registry() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_live_forms_equal_the_batch_over_random_cuts(spark, seed):
    """All entries of the registry, cut anywhere, what they keep carried on as lists of numbers."""
    b = bars(spark, 130, ("A",), seed=seed)
    want = features({"H1": b}, SPECS, "H1")["H1"].orderBy("ts").toPandas()
    arrays = {c: want[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
    rng = random.Random(seed)
    for spec in plan(SPECS, "H1"):
        kept, at, got = None, 0, []
        while at < 130:
            n = rng.choice([1, 1, 2, 5, 17, 60])
            form = LiveForm(spec)
            if kept is not None:
                form.restore([np.array(k) for k in kept])
            got.append(form({c: x[at : at + n] for c, x in arrays.items()}))
            kept, at = [k.tolist() for k in form.kept()], at + n
        for name in form.names:
            live = np.concatenate([g[name] for g in got])
            np.testing.assert_allclose(live, want[name].to_numpy(float), rtol=1e-8, atol=1e-8, err_msg=name)


def test_periods_of_a_specification_count(spark):
    b = bars(spark, 60, ("A",))
    out = features({"H1": b}, ["donchian(5)", "zscore(close,5)", "linreg_slope(close,5)"], "H1")["H1"].orderBy("ts").collect()
    assert all(r[c] is not None for r in out[4:] for c in out[0].asDict() if c.endswith("h1") and "pos" not in c)


def test_live_indicators_in_a_stream_and_after_a_restart(stateful, tmp_path):
    spark, b = stateful, bars(stateful, 70)
    rows = sorted(b.collect(), key=lambda r: (r.ts, r.symbol))
    specs = ["ema(close,6)", "rsi(close,5)", "bollinger(close,8)", "supertrend(5)", "adx(6)", "stochastic(5,3,2)", "kama(close,6)"]
    want = features({"H1": b}, specs, "H1")["H1"]
    names = [c for c in want.columns if c.endswith("_h1")]
    folder = str(tmp_path)
    for part in (rows[:50], rows[50:53], rows[53:90]):
        feed(spark, f"{folder}/in", part)
    run(live_indicators(source(spark, f"{folder}/in"), specs, "H1"), folder)
    feed(spark, f"{folder}/in", rows[90:])
    feed(spark, f"{folder}/in", rows[:4])  # bars that were there before are ignored
    same(run(live_indicators(source(spark, f"{folder}/in"), specs, "H1"), folder).collect(), want.collect(), names)


def test_late_bars_are_put_in_order(stateful, tmp_path):
    spark, b = stateful, bars(stateful, 60)
    specs = ["ema(close,6)", "atr(5)", "parabolic_sar", "williams_r(7)"]
    want = features({"H1": b}, specs, "H1")["H1"]
    folder, came = str(tmp_path), shuffled(b.collect(), 3, dt.timedelta(hours=9))
    for at in range(0, len(came), 25):
        feed(spark, f"{folder}/in", came[at : at + 25])
    feed(spark, f"{folder}/in", [("end", "H1", END, 1.0, 1.0, 1.0, 1.0, 1)])
    got = run(live_indicators(source(spark, f"{folder}/in"), specs, "H1", "10 hours"), folder).filter("symbol <> 'end'")
    same(got.collect(), want.collect(), [c for c in want.columns if c.endswith("_h1")])


def registers(spark, b):
    keep = dt.timedelta(hours=30)
    hi = b.withColumns({"hi": rolling.highest("high", 8), "lo": rolling.lowest("low", 8)}).withColumns({"r": rolling.prev("hi"), "s": rolling.prev("lo")}).drop("hi", "lo")
    return {
        "gaps": (b, lambda s: live_gap_register(s, None, "10 hours"), structure.gap_register(b), ["gap_new", "gaps_filled", "gaps_open"]),
        "expiring": (b, lambda s: live_gap_register(s, keep, "10 hours"), structure.gap_register(b, keep), ["gap_new", "gaps_filled", "gaps_open"]),
        "pools": (b, lambda s: live_liquidity_pools(s, 3, 2, 0.02, "10 hours"), structure.liquidity_pools(structure.swings(b, 3, 2), 0.02), ["swing_high", "swing_low", "pool_high_touches", "pool_low_touches", "swept_highs", "swept_lows"]),
        "breaks": (hi, lambda s: live_level_breaks(s, "r", "s", 10, 1.1, "10 hours"), structure.level_breaks(hi, "r", "s", 10, 1.1), ["level_break", "break_confirmed"]),
    }


@pytest.mark.parametrize("name", ["gaps", "expiring", "pools", "breaks"])
def test_registers_equal_the_batch_with_late_bars_and_a_restart(stateful, tmp_path, name):
    spark = stateful
    b, live, want, columns = registers(spark, bars(spark, 120, seed=4))[name]
    schema = STREAM + ("" if name != "breaks" else ", r double, s double")
    folder, came = str(tmp_path), shuffled(b.collect(), 5, dt.timedelta(hours=9))
    for part in (came[:90], came[90:130]):
        feed(spark, f"{folder}/in", part, schema)
    run(live(source(spark, f"{folder}/in", schema)), folder)
    feed(spark, f"{folder}/in", came[130:], schema)
    feed(spark, f"{folder}/in", [("end", "H1", END, *[1.0] * 4, 1, *[1.0] * (len(b.columns) - 8))], schema)
    got = run(live(source(spark, f"{folder}/in", schema)), folder).filter("symbol <> 'end'").collect()
    want = want.collect()
    same(got, want, columns)
    moved = [r for r in want if any(r[c] for c in columns if not c.startswith("swing"))]
    assert len(moved) > 5


def test_zones_equal_the_batch_with_late_bars(stateful, tmp_path):
    spark, b, folder = stateful, bars(stateful, 120, seed=4), str(tmp_path)
    came = shuffled(b.collect(), 6, dt.timedelta(hours=9))
    for at in range(0, len(came), 70):
        feed(spark, f"{folder}/in", came[at : at + 70])
    feed(spark, f"{folder}/in", [("end", "H1", END, 1.0, 1.0, 1.0, 1.0, 1)])
    got = run(live_zone_life(source(spark, f"{folder}/in"), 12, late="10 hours"), folder).filter("symbol <> 'end'")
    age = lambda e: F.min(F.when(F.col("event") == e, F.col("age")))
    zone = ["symbol", "born", "z_kind", "z_bottom", "z_top"]
    made = got.groupBy(*zone).agg(age("touched").alias("touch_age"), age("filled").alias("fill_age"), age("over").alias("over"))
    want = levels.zone_life(patterns.fair_value_gap(b), life=12)
    known = want.filter("state <> 'alive'").collect()  # those that nothing has happened to show up at their end only
    assert len(known) > 5
    same(made.filter("touch_age IS NOT NULL OR fill_age IS NOT NULL").collect(), known, ["touch_age", "fill_age"], zone)
    assert {r.over for r in made.filter("born < '2024-01-05'").collect()} == {12}


def test_alignment_equals_the_batch_at_any_arrival_order(stateful, tmp_path):
    spark, b, folder = stateful, bars(stateful, 96, tf="M30", seed=7), str(tmp_path)
    b = b.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01' + (ts - TIMESTAMP_NTZ '2024-01-01') / 2"))
    longer = {tf: resample(b, tf) for tf in ("H1", "H4")}
    want = joins.align(b, "M30", longer, ["close", "high"])
    for k, (tf, rows) in enumerate([("M30", b), *longer.items()]):
        came = shuffled(rows.collect(), k, dt.timedelta(hours=3))
        for at in range(0, len(came), 60):
            feed(spark, f"{folder}/{tf}", came[at : at + 60])
    feed(spark, f"{folder}/M30", [("end", "M30", END, 1.0, 1.0, 1.0, 1.0, 1)])
    # each source has as many files as it has; what is behind the watermark of all by less than this is still taken
    live = live_align(source(spark, f"{folder}/M30"), "M30", {tf: source(spark, f"{folder}/{tf}") for tf in longer}, ["close", "high"], "3000 days")
    got = run(live, folder)
    assert got.count() == 0  # nothing has passed the watermark yet
    feed(spark, f"{folder}/M30", [("end", "M30", END + dt.timedelta(days=4000), 1.0, 1.0, 1.0, 1.0, 1)])
    got = run(live, folder).filter("symbol <> 'end'")
    same(got.collect(), want.collect(), ["open", "high", "low", "close", "volume", "H1_close", "H1_high", "H4_close", "H4_high"])
