import datetime as dt

import pytest

from sandpiper.sources import requests as rq

from .test_candles import bars


def test_ranges():
    now = dt.datetime(2024, 3, 6, 13, 37)
    assert rq.complete_range("H4", 3, 1, now) == (dt.datetime(2024, 3, 6, 0), dt.datetime(2024, 3, 6, 8))
    assert rq.complete_range("W1", 1, 0, now) == (dt.datetime(2024, 2, 25), dt.datetime(2024, 3, 3))
    assert rq.complete_range("MN1", 3, 0, now) == (dt.datetime(2023, 12, 1), dt.datetime(2024, 3, 1))


def test_scan_requests(spark):
    b = bars(spark, 60)
    assert rq.ScanRequest("A", "1h", ("h1",), "number", 10, 4).apply(b).count() == 6
    assert rq.ScanRequest("A", "H1", (), "time", "2024-01-02 00:00:00", None).apply(b).count() == 36
    assert rq.ScanRequest("B", "H1", (), "periods", 1, 0).apply(b, dt.datetime(2024, 1, 3, 5)).count() == 24
    with pytest.raises(FileNotFoundError, match="H4"):
        rq.ScanRequest("A", "H1", ("H4",), "number", 5).apply(b)
    assert rq.ScanRequest("A", "H1", ("H4",), "number", 5).apply(b, strict=False).count() == 5
    for bad in ({"mode": "x"}, {"mode": "number", "start": 0}, {"mode": "number", "start": 2, "end": 3}):
        with pytest.raises(ValueError, match="mode|start"):
            rq.ScanRequest("A", "H1", (), **bad)
    with pytest.raises(ValueError, match="shorter"):
        rq.ScanRequest("A", "H1", ("M5",), "number", 5)


def test_tables(spark):
    need = "symbol string, tf string, needed long"
    got = rq.required_bars(spark.createDataFrame([("A", "H1", 20), ("A", "H4", 5)], need), spark.createDataFrame([("A", "H1", 8), ("B", "H1", 3)], need))
    assert {tuple(r) for r in got.collect()} == {("A", "H1", 20), ("A", "H4", 5), ("B", "H1", 3)}
    assert rq.download_plans(spark, ["A", "B", "A"], ["4h", "H1"], 9).count() == 4
    raw = spark.createDataFrame([("A", "H1", 0, 5), ("A", "H1", 2, 6), ("B", "H1", 0, 7), ("B", "H1", None, 8)], "symbol string, tf string, tick_volume long, real_volume long")
    assert sorted((r.symbol, r.volume) for r in rq.pick_volume(raw).collect()) == [("A", 0), ("A", 2), ("B", 7), ("B", 8)]
    spec = "symbol string, tick_size double, tick_value double, pip_size double, contract_size double, volume_min double, volume_step double, volume_max double, stop_level double, point double"
    one = rq.instruments(spark.createDataFrame([("E", 0.01, 1.0, 0.1, 100.0, 0.01, 0.01, 5.0, None, 0.01)], spec)).first()
    assert (one.value_per_unit, one.pip_value, one.stop_distance) == (100.0, 10.0, 0.0)
    with pytest.raises(ValueError, match="unusable"):
        rq.instruments(spark.createDataFrame([("E", 0.0, 1.0, 0.1, 100.0, 0.01, 0.01, 5.0, None, 0.01)], spec))


def test_news(spark):
    from sandpiper.queries import _news

    assert [r.title for r in rq.news_range(_news(spark), "2024-01-03 09:30:00", "2024-01-10 00:00:00", ["usd"], ["HIGH", "medium"]).orderBy("time_utc").collect()] == ["Jobs", "Holiday talks"]
