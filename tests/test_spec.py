import pytest

from sandpiper.functions.spec import SpecError, parse, replace_params, split_top, value
from sandpiper.functions.time_features import check_time_features
from sandpiper.plans.features import plan, select_columns, warmup
from sandpiper.plans.registry import REGISTRY
from sandpiper.sources.candles import timeframe, timeframes


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("sma(close, 5)@H1", "sma(column=close,period=5,min_periods=-1)@H1"),
        ("sma(n=5)@1h", "sma(column=close,period=5,min_periods=-1)@H1"),
        (" BOLLINGER_BANDS ( close , 8 , 2 ) @ m1 ", "bollinger_bands(column=close,period=8,multiplier=2.0,min_periods=-1)@M1"),
        ("obv@D1", "obv()@D1"),
        ("rsi(method='wilders')", "rsi(column=close,period=14,method=wilders)"),
        ("macd(fast=5, close, 20)@H4", "macd(column=close,fast=5,slow=20,signal=9)@H4"),
    ],
)
def test_valid(text, canonical):
    assert parse(text, REGISTRY).canonical == canonical


@pytest.mark.parametrize("text", ["", "sma(", "sma(5))", "nosuch(3)", "sma(close, 0)", "sma(close, 2.5)", "sma(close, True)", "sma(foo=3)", "sma(close, 5, -1, 9)", "sma(n=5, period=6)", "rsi(method=sma)", "sma(volume, 5)", "sma(close,,5)", "sma(close, 5)@Q9"])
def test_invalid(text):
    with pytest.raises(SpecError):
        parse(text, REGISTRY)


def test_pieces():
    assert split_top("a, f(b, c), 'x, y', [1, 2]") == ["a", "f(b, c)", "'x, y'", "[1, 2]"]
    assert [value(x) for x in ("TRUE", "none", "3", "2.5", "[a, 1]", "'q'", "word")] == [True, None, 3, 2.5, ["a", 1], "q", "word"]
    assert replace_params("sma(close, 5)@H1", REGISTRY, period=9) == "sma(column=close,period=9,min_periods=-1)@H1"
    assert timeframes(["d1", "1m", "H4", "4h", "mn1"]) == ["M1", "H4", "D1", "MN1"]
    with pytest.raises(ValueError, match="unknown"):
        timeframe("7x")
    with pytest.raises(ValueError, match="below D1"):
        check_time_features(["hour"], "D1")


def test_planning():
    specs = plan(["sma(close,5)", "sma(period=5)@H1", "macd()@H4", "tema(n=7)@H4"], "H1")
    assert len(specs) == 3 and warmup(specs) == {"H1": 5, "H4": 34}
    assert select_columns(["sma_5", "ema_5", "bb_upper"], ["*_5"], ["ema"]) == ["sma_5"]
