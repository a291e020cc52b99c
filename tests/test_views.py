import datetime as dt

import pytest

from sandpiper.operators import rolling
from sandpiper.sources import views
from sandpiper.sources.candles import feature_metadata

from .test_candles import bars


def test_columns_of_timeframes():
    found = views.timeframe_columns(["symbol", "D1_close", "H4_open", "H4_close", "x_close", "H4_rsi"])
    assert found == {"H4": {"open": "H4_open", "close": "H4_close"}, "D1": {"close": "D1_close"}} and list(found) == ["H4", "D1"]


def test_first_filled(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, 2.0, None)], "a double, b double, c double")
    assert views.first_filled(df, ["z", "a", "b", "c"]) == "b" and views.first_filled(df, ["z", "a"]) is None and views.first_filled(df, ["z"]) is None


def test_row_at_an_exact_time(spark):
    b = bars(spark, 10)
    rows = views.row_at(b, "2024-01-01 03:00:00").collect()
    assert {r.symbol for r in rows} == {"A", "B"} and {r.ts for r in rows} == {dt.datetime(2024, 1, 1, 3)}
    with pytest.raises(Exception, match="0 rows at that time"):
        views.row_at(b, "2030-01-01 00:00:00").collect()
    with pytest.raises(Exception, match="2 rows at that time"):
        views.row_at(b.union(b), "2024-01-01 03:00:00").collect()


def test_check_dataset(spark):
    b = bars(spark, 5, ("A",))
    assert views.check_dataset(b, "A", ["1h"]).count() == 5
    with pytest.raises(ValueError, match="symbol"):
        views.check_dataset(b, "B", ["H1"])
    with pytest.raises(ValueError, match="timeframes"):
        views.check_dataset(b, "A", ["H1", "D1"])


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_features_survive_the_store(spark, tmp_path, kind):
    f = rolling.sma(bars(spark, 30), period=5)
    views.save_features(f, feature_metadata(f, ["close", "sma"]), str(tmp_path / "s"), kind)
    back, meta = views.read_features(spark, str(tmp_path / "s"), kind)
    assert back.select("symbol", "close", "sma").exceptAll(f.select("symbol", "close", "sma")).count() == 0 and back.count() == 60
    assert {r.column: r.nan_count for r in meta.collect()} == {"close": 0, "sma": 8}
    with pytest.raises(ValueError):
        views.save_features(f, f, str(tmp_path / "x"), "orc")


def test_news_survive_the_store(spark, tmp_path):
    assert views.read_news(spark, str(tmp_path / "none")).count() == 0
    row = (dt.datetime(2024, 1, 1), "USD", "high", "t", 30, 15)
    views.save_news(spark.createDataFrame([row], views.NEWS), str(tmp_path / "n"))
    assert [tuple(r) for r in views.read_news(spark, str(tmp_path / "n")).collect()] == [row]


def test_moments():
    utc = dt.UTC
    assert views.moment(None, "UTC") is None and views.moment("", "UTC") is None
    assert views.moment("2024-03-01 12:00", "Europe/Berlin", "UTC") == dt.datetime(2024, 3, 1, 11, tzinfo=utc)
    assert views.moment(dt.date(2024, 7, 1), "Europe/Berlin") == dt.datetime(2024, 6, 30, 22, tzinfo=utc)
    assert views.moment("2024-03-01T12:00:00Z", None, "Asia/Tokyo").hour == 21 and views.moment(0, "UTC") == dt.datetime(1970, 1, 1, tzinfo=utc)
    assert views.moment("now", "UTC").tzinfo is not None
    for bad in (("2024-03-01", None), ("2024-03-01T00:00:00Z", None), ("no date", "UTC"), ("2024-03-01", "Nowhere/Land")):
        with pytest.raises(ValueError):
            views.moment(*bad)
    for odd in (True, [1]):
        with pytest.raises(TypeError):
            views.moment(odd, "UTC")
