import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sandpiper.operators import accounts, levels, patterns, recursive, rolling, structure, zones
from sandpiper.queries import ORACLE_SQL, QUERIES
from sandpiper.streaming.live import live_swings

from .test_candles import bars
from .test_streaming import run


def series_of(df, *names):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.symbol, r.ts)):
        out.setdefault(r.symbol, []).append(tuple(r[n] for n in names))
    return out


@pytest.mark.parametrize("make", [
    lambda b: structure.swing_trend(structure.swings(b, 3, 3)), lambda b: structure.causal_swings(b, 0.02), structure.gap_register, lambda b: structure.liquidity_pools(structure.swings(b, 2, 2), 0.01),
    structure.volatility_threshold, lambda b: zones.fusion(zoned(b), ["fvg", "ob"]),
])
def test_no_later_bar_changes_an_earlier_value(spark, make):
    b = bars(spark, 80)
    first = b.filter("ts < '2024-01-03 02:00:00'")
    whole, part = make(b), make(first)
    names = [c for c in whole.columns if c not in b.columns]
    assert {k: v[:50] for k, v in series_of(whole, *names).items()} == series_of(part, *names)


def test_causal_swings_alternate_and_are_found_late_enough(spark):
    for rows in series_of(structure.causal_swings(bars(spark, 400), 0.06), "high", "low", "cs", "cs_price", "cs_age").values():
        found = [(k, kind, price, int(age)) for k, (_, _, kind, price, age) in enumerate(rows) if kind]
        assert len(found) > 3
        assert all(a[1] == -b[1] for a, b in zip(found, found[1:], strict=False))
        for k, kind, price, age in found:
            assert rows[k - age][0 if kind == 1 else 1] == price
        for k, kind, price, _ in found[1:]:
            assert kind * (price - rows[k][1 if kind == 1 else 0]) >= 0.06 * price - 1e-9


def test_live_swings_are_the_batch_ones(spark, tmp_path):
    b = bars(spark, 120)
    rows = sorted(b.collect(), key=lambda r: r.ts)
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, b.schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    names = ("symbol", "ts", "cs", "cs_price", "cs_age")
    got = sorted(tuple(r[n] for n in names) for r in run(spark, live_swings(stream, 0.02)))
    assert got == sorted(tuple(r[n] for n in names) for r in structure.causal_swings(b, 0.02).filter("cs <> 0").collect())
    assert len(got) > 6


def test_pools_by_brute_force(spark):
    for rows in series_of(structure.liquidity_pools(structure.swings(bars(spark, 200), 2, 2), 0.01), "high", "low", "swing_high", "swing_low", "pool_high_touches", "pool_low_touches", "swept_highs", "swept_lows").values():
        pools, seen = {1: [], -1: []}, 0
        for high, low, top, bottom, *got in rows:
            want = []
            for side, price in ((1, top), (-1, bottom)):
                near = next((p for p in pools[side] if price is not None and abs(price - p[0]) / p[0] <= 0.01), None)
                if price is not None and near is None:
                    near = [price, 0, False]
                    pools[side].append(near)
                if near is not None:
                    near[1] += 1
                want.append(None if price is None else near[1])
            for side, reach in ((1, high), (-1, low)):
                swept = [p for p in pools[side] if not p[2] and side * (reach - p[0]) > 0]
                for p in swept:
                    p[2] = True
                want.append(len(swept))
            seen += sum(x or 0 for x in want)
            assert [None if x is None or x != x else x for x in got] == want
        assert seen > 20


def zoned(b):
    b = patterns.fair_value_gap(patterns.order_block(rolling.atr_classic(b, 5)))
    return zones.zone_status(zones.zone_status(b, "fvg", "fvg_bottom", "fvg_top"), "ob", "ob_bottom", "ob_top")


def test_fusion_by_brute_force(spark):
    names, alpha = ["fvg", "ob"], 2 / 6
    columns = [f"{n}_{c}" for n in names for c in ("score", "alive", "age", "filled", "expired", "active_top", "active_bottom")]
    made = zones.fusion(zoned(bars(spark, 300)), names, enter=0.25, leave=0.15, least=0.1)
    ever = 0
    for rows in series_of(made, *columns, "sr_score_raw", "sr_on", "sr_score", "sr_top", "sr_bottom", "sr_source").values():
        smooth, on, ended = [None, None], 0, [[], []]
        for row in rows:
            sides = [dict(zip(("score", "alive", "age", "filled", "expired", "top", "bottom"), row[7 * k : 7 * k + 7], strict=True)) for k in range(2)]
            now = []
            for k, z in enumerate(sides):
                smooth[k] = z["score"] if smooth[k] is None else alpha * z["score"] + (1 - alpha) * smooth[k]
                ended[k].append(z["filled"] or z["expired"])
                now.append(smooth[k] / (1 + z["age"] / 5) if z["alive"] and not any(ended[k][-3:]) else 0.0)
            raw = max(now)
            on = int(raw >= 0.25) if not on else int(raw >= 0.15)
            near = [k for k in range(2) if raw - now[k] <= 0.02]
            best = min(near, key=lambda k: (not sides[k]["alive"], sides[k]["age"] or 0, k))
            got = row[14:]
            assert got[0] == pytest.approx(raw) and got[1] == on and got[2] == pytest.approx(raw if on else 0)
            assert got[3:] == ((sides[best]["top"], sides[best]["bottom"], names[best]) if on else (None, None, None))
            ever += on
    assert ever > 3


def test_empty_and_null_bars(spark):
    b = bars(spark, 30, ("A",))
    for df in (b.filter("false"), b.withColumn("volume", F.lit(None).cast("long"))):
        out = structure.soft_confirmations(structure.level_breaks(recursive.zigzag(zones.breaker(zoned(df)), 0.02), "ob_top", "ob_bottom"))
        assert out.count() == df.count()
    assert structure.signal_confluence(spark.createDataFrame([("A", "H1", 1, "x", None, None), ("A", "H1", 2, "x", 3.0, 1.0)], "symbol string, tf string, ts int, kind string, value double, weight double")).select("confluence_score").collect() == [(1.0,), (2.0,)]
    with pytest.raises(ValueError):
        zones.fusion(b, ["x"], enter=0.1, leave=0.2)


def test_round_trip_refuses_unequal_sides(spark):
    entries = spark.createDataFrame([(1, "A", 1.0, 2.0), (2, "B", 1.0, 2.0)], "trade_id int, symbol string, lots double, total_cost double")
    assert accounts.round_trip(entries, entries.filter("trade_id = 1")).select("round_trip_cost").collect() == [(4.0,)]
    with pytest.raises(Exception, match="same symbol and lots"):
        accounts.round_trip(entries, entries.withColumn("lots", F.lit(3.0))).collect()


def test_swing_points_with_and_without_an_end(spark):
    swings = spark.createDataFrame([("A", "H1", k, kind, p) for k, (kind, p) in enumerate([(1, 110.0), (-1, 100.0), (1, 108.0), (-1, 98.25)])] + [("B", "H1", 0, 1, 5.0)], "symbol string, tf string, ts int, zz int, zz_price double")
    legs = levels.legs(swings)
    assert [tuple(r) for r in levels.swing_points(legs).collect()] == [("A", "H1", 110.0, 100.0, 108.0, 98.25)]
    assert [tuple(r) for r in levels.swing_points(legs, False).collect()] == [("A", "H1", 100.0, 108.0, 98.25, None)]
    assert levels.equal_legs(levels.swing_points(legs)).select("abcd").collect() == [(1,)]
    got = levels.projections(levels.swing_points(legs, False), (1.0, 2.0)).select("d_expected", "d_error").collect()
    assert sorted(tuple(r) for r in got) == [(106.25, None), (114.25, None)]


def test_pools_at_and_below_zero_follow_the_sql(spark, tmp_path):
    """Swings at zero, beside it and below it, against the query's own SQL."""
    price = [5.0, 4.0, 2.0, 0.0, 3.0, 4.5, 9.0, 6.0] * 4 + [5.0, 4.0, 2.0, 0.01, 3.0, 4.5, 9.2, 6.0] * 2
    values = [("flat", p) for p in price] + [("high", min(0.0, p - 9.0)) for p in price] + [("under", p - 3.0) for p in price] + [("none", 0.0) for _ in price]
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k % len(price)), symbol, v) for k, (symbol, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["symbol", "ts", "pool_high_touches", "pool_low_touches", "swept_highs", "swept_lows"]
    got = QUERIES["liquidity_pools"](spark, str(tmp_path)).select(columns).collect()
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['liquidity_pools']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.symbol for r in got if r.pool_low_touches is not None} >= {"flat", "under"} and max(r.pool_low_touches or 0 for r in got) > 2


def test_pools_at_zero_are_not_searched():
    pools = structure.Pools(0.05)
    assert [pools.join(-1, p) for p in (0.0, 0.0, 1.0, 0.0, 1.04, -2.0, 0.0, 7.0)] == [1, 1, 1, 1, 2, 1, 2, 3]
    assert structure.Pools(1.0).join(1, 4.0) == 1
