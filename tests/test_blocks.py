"""Recurrences in blocks against the pass over whole series, at any length of the blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sandpiper.operators import blocks, recursive

from .test_candles import bars


def same(got, want, names):
    pick = lambda df: {(r.symbol, r.ts): [r[n] for n in names] for r in df.collect()}
    got, want = pick(got), pick(want)
    assert got.keys() == want.keys()
    for k, w in want.items():
        for a, b in zip(got[k], w, strict=True):
            assert (a is None) == (b is None), (k, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9), k


def sparse(spark):
    """Two series, one of them with gaps of days, and null closes in both: at the start, alone, and in a row."""
    rng = random.Random(8)
    b = bars(spark, 150)
    gone = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(150) if 40 < h < 95 or rng.random() < 0.2]
    blank = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in (0, 1, 7, 20, 21, 22, 100)]
    b = b.filter(~((F.col("symbol") == "B") & F.col("ts").isin(gone)))
    return b.withColumn("close", F.when(~F.col("ts").isin(blank), F.col("close")))


@pytest.mark.parametrize("length", ["1 HOUR", "7 HOURS", "1 DAY", "400 DAYS"])
def test_blocks_of_any_length_equal_the_whole(spark, length):
    for b in (bars(spark, 90).cache(), sparse(spark).cache()):
        same(blocks.ema(b, "close", 6, length=length), recursive.ema(b, "close", 6), ["ema"])
        same(blocks.rsi(b, "close", 5, length=length), recursive.rsi(b, "close", 5), ["rsi"])
        same(blocks.kama(b, "close", 5, length=length), recursive.kama(b, "close", 5), ["kama"])
        b.unpersist()


def test_rows_before_a_block(spark):
    """Each block has exactly the rows that lie before it, up to n, wherever they are."""
    b = sparse(spark).select("symbol", "tf", "ts", "close")
    times = {}
    for r in b.collect():
        times.setdefault(r.symbol, []).append(r.ts)
    for length, hours in (("2 HOURS", 2), ("1 DAY", 24)):
        rows = blocks.with_rows_before(b, 9, length).collect()
        for symbol, own in times.items():
            own.sort()
            of = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() // 3600 // hours)
            for block in {of(t) for t in own}:
                mine = [t for t in own if of(t) == block]
                want = [t for t in own if t < mine[0]][-9:]
                got = [(r.ts, r["__own"]) for r in rows if r.symbol == symbol and r["__block"] == block]
                assert sorted(got) == sorted([(t, True) for t in mine] + [(t, False) for t in want])


def test_no_series_is_grouped_whole(spark):
    """The passes over rows are grouped by block; only one row a block is ordered over a series."""
    plan = blocks.rsi(bars(spark, 30), period=5)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line]
    assert groups and sum("__block" in g.split("(", 1)[0] or "__block" in g for g in groups) >= 3


def test_an_empty_table(spark):
    none = bars(spark, 5).limit(0)
    assert blocks.ema(none).count() == 0 and blocks.kama(none).columns[-1] == "kama"
