"""Positions and drawdown where fills tie in their order."""

import random
from datetime import datetime

import pytest

from sandpiper.queries import QUERIES

LINES = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
COLUMNS = ["account", "execution_id", "fill_no", "position", "cash", "action", "equity", "peak", "total_drawdown", "daily_drawdown"]


def tied_lines():
    """Five fills for each key, two keys a day; quantities are multiples of 25, so that sums of lots are exact."""
    rng = random.Random(7)
    return [
        (order, account, 1, 25.0 * rng.randint(1, 4), 1600.0 * rng.randint(1, 9), rng.choice([0.0, 0.25]), rng.choice("RNA"), rng.choice("OF"), datetime(2024, 1, day))
        for account in (1, 2, 3) for day in range(1, 9) for order in (2 * day, 2 * day + 1) for _ in range(5)
    ]


def by_loop(lines):
    fills = []
    for order, account, number, quantity, extended, tax, flag, status, ts in lines:
        side, lots = -1 if flag == "R" else 1, quantity / 100
        price = extended / quantity + side * 0.5 + side * tax
        fee = max(0.7 * lots if status == "O" else 0.7 / 100 * price * lots if flag == "A" else 0.7, 0.05)
        fills.append((account, ts, order, number, side, lots, price, fee))
    out, held = [], None
    for account, ts, order, number, side, lots, price, fee in sorted(fills):
        if held != account:
            held, position, cash, peak, day = account, 0.0, 0.0, 0.0, None
        old, position, cash = position, position + side * lots, cash - side * lots * price - fee
        equity = cash + position * price + 1_000_000
        peak = max(peak, equity)
        if day != ts:
            day, start = ts, equity
        action = "OPEN" if old == 0 else "CLOSE" if position == 0 else "REVERSE" if old * position < 0 else "INCREASE" if abs(position) > abs(old) else "REDUCE"
        out.append((account, order, number, position, cash, action, equity, peak, max(0.0, (peak - equity) / peak), max(0.0, (start - equity) / start)))
    return sorted(out)


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_tied_fills_give_the_same_rows_however_the_table_is_stored(spark, tmp_path, seed):
    lines = tied_lines()
    want = by_loop(lines)
    assert {"OPEN", "CLOSE", "REVERSE", "INCREASE", "REDUCE"} == {r[5] for r in want}
    if seed is not None:
        random.Random(seed).shuffle(lines)
    spark.createDataFrame(lines, LINES).repartition(seed or 1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["positions_drawdown"](spark, str(tmp_path)).select(COLUMNS).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] + (g[5],) == w[:3] + (w[5],)
        assert [g[i] for i in (3, 4, 6, 7, 8, 9)] == pytest.approx([w[i] for i in (3, 4, 6, 7, 8, 9)], rel=0, abs=2e-6)
