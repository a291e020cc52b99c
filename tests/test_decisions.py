"""The ordered chain against a plain loop over dictionaries, and cases of whole decisions."""

import random

import pytest

from sandpiper.operators.accounts import simulate
from sandpiper.operators.decisions import Limits, audit, evaluate, targets

ACCOUNT = "d string, equity double, free_margin double, used_margin double, margin_level double, leverage double, drawdown double, daily_drawdown double, portfolio_risk double, blocked boolean"
SYMBOLS = "d string, symbol string, target double, capital double, margin double, current double, current_margin double, positions int, margin_rate double, stop_lots double, lot_value double"
PAIRS = "d string, symbol_a string, symbol_b string, rho double"


def plain(account, rows, pairs, limits):
    """(verdict, codes with symbols, changes, targets) of one decision."""
    _, equity, free, used, level, leverage, drawdown, daily, risk, blocked = account
    for code, broken in (
        ("NO_USABLE_CAPITAL", equity <= 0), ("INSUFFICIENT_FREE_MARGIN", free < 0), ("INVALID_MARGIN_LEVEL", used > 0 and level <= 0), ("INVALID_LEVERAGE", leverage <= 0),
        ("MAX_ACCOUNT_LEVERAGE", limits.leverage is not None and leverage > limits.leverage), ("RISK_BLOCKED", blocked), ("MAX_DRAWDOWN", drawdown >= limits.drawdown),
        ("MAX_DAILY_DRAWDOWN", daily >= limits.daily_drawdown), ("MAX_PORTFOLIO_RISK", risk > limits.portfolio_risk),
    ):
        if broken:
            return "REJECTED", [(code, None)], [], {}
    book = {r[1]: dict(zip(("target", "capital", "margin", "current", "current_margin", "positions", "margin_rate", "stop_lots", "lot_value"), r[2:], strict=True)) for r in rows}
    asked = sorted(s for s, b in book.items() if b["target"] is not None)
    notes, changes = [], []

    def put(code, symbol, field, value):
        if value != book[symbol][field]:
            changes.append((code, symbol, field, book[symbol][field], value))
            book[symbol][field] = value

    held = lambda b: b["current"] if b["target"] is None else b["target"]
    whole = lambda: sum(abs(held(b)) for b in book.values())

    def margin():
        need = 0.0
        for b in book.values():
            size = abs(held(b))
            if size > 1e-12:
                need += size * equity * b["margin_rate"] if b["margin_rate"] is not None else b["current_margin"] * size / abs(b["current"]) if abs(b["current"]) > 1e-12 else 0.0
        return need

    def limit(value, most):
        return value if abs(value) <= most else most if value > 0 else -most

    for s in asked:
        if abs(book[s]["target"]) > limits.symbol_exposure:
            put("MAX_SYMBOL_EXPOSURE", s, "target", limit(book[s]["target"], limits.symbol_exposure))
            notes.append(("MAX_SYMBOL_EXPOSURE", s))
    if (t := whole()) > limits.total_exposure:
        for s in asked:
            put("MAX_TOTAL_EXPOSURE", s, "target", book[s]["target"] * limits.total_exposure / t)
        notes.append(("MAX_TOTAL_EXPOSURE", None))
    was = {s: book[s]["target"] for s in asked}
    for _, a, b, rho in sorted(pairs):
        if a < b and abs(rho) >= limits.correlation:
            together = sum(abs(book[s]["target"]) for s in (a, b) if s in asked)
            if together > limits.correlated_exposure:
                for s in (a, b):
                    if s in asked:
                        book[s]["target"] *= limits.correlated_exposure / together
                notes.append(("MAX_CORRELATED_EXPOSURE", None))
    changes += [("MAX_CORRELATED_EXPOSURE", s, "target", was[s], book[s]["target"]) for s in asked if was[s] != book[s]["target"]]
    for s in asked:
        if abs(book[s]["capital"]) > limits.symbol_concentration:
            put("MAX_SYMBOL_CONCENTRATION", s, "capital", limit(book[s]["capital"], limits.symbol_concentration))
            notes.append(("MAX_SYMBOL_CONCENTRATION", s))
    m = margin()
    if m > 0 and m / equity > limits.margin_utilisation:
        for s in asked:
            for field in ("target", "capital", "margin"):
                put("MAX_MARGIN_UTILISATION", s, field, book[s][field] * min(1.0, limits.margin_utilisation * equity / m))
        notes.append(("MAX_MARGIN_UTILISATION", None))
    for s in asked:
        b = book[s]
        if b["stop_lots"] is not None and abs(b["target"]) > 1e-12 and (lots := abs(b["target"]) * equity / b["lot_value"]) > b["stop_lots"]:
            put("STOP_LOSS_RISK_CAP", s, "target", b["target"] * max(0.0, b["stop_lots"] / lots))
            notes.append(("STOP_LOSS_RISK_CAP", s))
    count = {s: 0 if abs(held(b)) <= 1e-12 else 1 if abs(b["current"]) <= 1e-12 else b["positions"] for s, b in book.items()}
    refused = None
    if limits.open_positions is not None and sum(count.values()) > limits.open_positions:
        refused = ("MAX_OPEN_POSITIONS", None)
    elif limits.positions_per_symbol is not None and (many := [s for s in sorted(count) if count[s] > limits.positions_per_symbol]):
        refused = ("MAX_POSITIONS_PER_SYMBOL", many[0])
    elif equity - margin() <= 0:
        refused = ("NO_FREE_MARGIN", None)
    if refused:
        return "REJECTED", [*notes, refused], changes, {}
    return ("MODIFIED" if notes else "APPROVED"), notes, changes, {s: (book[s]["target"], book[s]["capital"], book[s]["margin"]) for s in asked}


def drawn(seed, n=120):
    rng = random.Random(seed)
    accounts, symbols, pairs = [], [], []
    for k in range(n):
        d = f"d{k}"
        odd = lambda p, a, b: a if rng.random() < p else b
        equity = odd(0.04, -5.0, rng.choice([5_000.0, 10_000.0]))
        accounts.append((d, equity, odd(0.04, -1.0, 4_000.0), odd(0.5, 0.0, 800.0), odd(0.05, 0.0, 9.0), odd(0.04, 0.0, 100.0), odd(0.06, 0.2, 0.1), odd(0.06, 0.3, 0.01), odd(0.06, 0.7, 0.2), rng.random() < 0.04))
        names = rng.sample("ABCDEFG", rng.randrange(0, 7))
        for s in names:
            current = odd(0.4, 0.0, rng.uniform(-0.5, 0.5))
            symbols.append((d, s, odd(0.2, None, odd(0.1, 0.0, rng.uniform(-1, 1))), rng.uniform(-1, 1), rng.uniform(0, 3000), current, odd(0.3, 0.0, rng.uniform(0, 6000)), 0 if current == 0 else rng.randrange(1, 4), odd(0.5, None, rng.choice([0.01, 0.5, 3.0])), odd(0.6, None, rng.uniform(0, 0.05)), rng.choice([1_000.0, 100_000.0])))
        pairs += [(d, a, b, rng.choice([0.0, 0.5, 0.85, -0.95])) for a in names for b in "ABCDEFGH" if a != b and rng.random() < 0.5]
    return accounts, symbols, pairs


@pytest.mark.parametrize(("seed", "limits"), [(1, Limits()), (2, Limits(total_exposure=0.65, symbol_exposure=0.4, symbol_concentration=0.3, correlation=0.5, correlated_exposure=0.3, margin_utilisation=0.4, leverage=200.0, open_positions=5, positions_per_symbol=2)), (3, Limits(open_positions=0))])
def test_every_decision_against_a_plain_loop(spark, seed, limits):
    accounts, symbols, pairs = drawn(seed)
    got = evaluate(spark.createDataFrame(accounts, ACCOUNT), spark.createDataFrame(symbols, SYMBOLS), "d", limits, spark.createDataFrame(pairs, PAIRS)).cache()
    rows = {r.d: r for r in got.collect()}
    kept, changes = {}, {}
    for r in targets(got, "d").collect():
        kept.setdefault(r.d, {})[r.symbol] = (r.target, r.capital, r.margin)
    for r in audit(got, "d").orderBy("d", "step").collect():
        changes.setdefault(r.d, []).append((r.code, r.symbol, r.field, r.requested, r.final))
    seen = set()
    for account in accounts:
        d = account[0]
        verdict, notes, moved, final = plain(account, [s for s in symbols if s[0] == d], [p for p in pairs if p[0] == d], limits)
        assert (rows[d].verdict, [(n.code, n.symbol) for n in rows[d].notes]) == (verdict, notes), d
        assert kept.get(d, {}).keys() == final.keys()
        for s, values in final.items():
            assert kept[d][s] == pytest.approx(values, rel=1e-9, abs=1e-12)
        order = lambda rows: sorted(rows, key=lambda c: c[:3])
        mine, theirs = order(changes.get(d, [])), order(moved)
        assert [c[:3] for c in mine] == [c[:3] for c in theirs] and [c[3:] for c in mine] == [pytest.approx(c[3:], rel=1e-9, abs=1e-12) for c in theirs], d
        seen |= {c for c, _ in notes}
    got.unpersist()
    assert len(seen) > 8


THREE = [("XAUUSD", 0.10, 250.0, 1), ("EURUSD", 0.0, 0.0, 0), ("AUDUSD", 0.0, 0.0, 0)]
RHO = [("AUDUSD", "EURUSD", 0.8), ("AUDUSD", "XAUUSD", 0.0), ("EURUSD", "XAUUSD", 0.8)]


def whole(spark, wanted, limits, risk=0.1, blocked=False, drawdown=0.0):
    """A portfolio of three symbols, one of them held, as wanted: (target, capital, margin) by symbol."""
    account = spark.createDataFrame([("d", 10_000.0, 9_000.0, 1_000.0, 1000.0, 100.0, drawdown, 0.0, risk, blocked)], ACCOUNT)
    rows = spark.createDataFrame([("d", s, *wanted[s], current, used, n, None, None, None) for s, current, used, n in THREE], SYMBOLS)
    out = evaluate(account, rows, "d", limits, spark.createDataFrame([("d", *p) for p in RHO], PAIRS))
    return out.first(), {r.symbol: r for r in targets(out, "d").collect()}


def test_a_clean_request_is_approved(spark):
    wanted = {"XAUUSD": (0.20, 0.20, 100.0), "EURUSD": (0.15, 0.15, 100.0), "AUDUSD": (0.10, 0.10, 100.0)}
    row, final = whole(spark, wanted, Limits(correlation=0.9, correlated_exposure=1.0, open_positions=4), 0.2)
    assert row.verdict == "APPROVED" and not row.notes and not row.changes and row.margin == pytest.approx(500) and row.positions == 3
    assert {s: (r.target, r.capital, r.margin) for s, r in final.items()} == wanted


def test_stress_is_modified_in_several_ways_and_bounded(spark):
    wanted = {"XAUUSD": (0.80, 0.80, 3_000.0), "EURUSD": (0.60, 0.20, 2_000.0), "AUDUSD": (0.40, 0.20, 1_500.0)}
    limits = Limits(total_exposure=0.65, symbol_exposure=0.4, symbol_concentration=0.3, correlation=0.7, correlated_exposure=0.4, open_positions=5)
    row, final = whole(spark, wanted, limits, 0.4)
    assert row.verdict == "MODIFIED" and row.exposure <= 0.65 + 1e-12
    assert {n.code for n in row.notes} == {"MAX_SYMBOL_EXPOSURE", "MAX_TOTAL_EXPOSURE", "MAX_CORRELATED_EXPOSURE", "MAX_SYMBOL_CONCENTRATION"}
    assert all(abs(r.target) <= 0.4 and abs(r.capital) <= 0.3 for r in final.values())
    assert (whole(spark, wanted, limits, 0.4)[0]) == row


def test_positions_reject_after_the_chain(spark):
    row, final = whole(spark, {s: (0.1, 0.1, 100.0) for s, *_ in THREE}, Limits(symbol_exposure=1.0, symbol_concentration=1.0, correlation=0.95, correlated_exposure=1.0, open_positions=2))
    assert row.verdict == "REJECTED" and [n.code for n in row.notes] == ["MAX_OPEN_POSITIONS"] and row.notes[0].severity == "critical" and not final
    assert whole(spark, {s: (0.1, 0.1, 1.0) for s, *_ in THREE}, Limits(), blocked=True)[0].notes[0].code == "RISK_BLOCKED"
    assert whole(spark, {s: (0.1, 0.1, 1.0) for s, *_ in THREE}, Limits(), drawdown=0.2)[0].notes[0].code == "MAX_DRAWDOWN"


def test_odd_decisions(spark):
    """Without symbols, without pairs, with columns missing, and an empty table."""
    account = spark.createDataFrame([("d", 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, False)], ACCOUNT)
    some = spark.createDataFrame([("d", "A", 0.9)], "d string, symbol string, target double")
    assert evaluate(account, some.limit(0), "d").first().verdict == "APPROVED"
    row = evaluate(account, some, "d").first()
    assert (row.verdict, [n.code for n in row.notes], row.symbols[0].target) == ("MODIFIED", ["MAX_SYMBOL_EXPOSURE"], 0.5)
    assert evaluate(account.limit(0), some, "d").count() == 0
    for bad in ({"total_exposure": 1.5}, {"leverage": 0.0}, {"open_positions": True}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_fills_that_cancel_leave_an_account_flat(spark):
    fills = spark.createDataFrame([("a", k, *f) for k, f in enumerate([(1, 0.1, 10.0, 0.0), (1, 0.2, 10.0, 0.0), (-1, 0.3, 12.0, 0.0), (1, 1.0, 5.0, 0.0)])], "account string, n int, side int, lots double, fill_price double, commission double")
    got = simulate(fills, ("account",), ("n",)).orderBy("n").collect()
    assert [r.held for r in got] == [0.1, 0.3, 0.0, 1.0] and [r.entry_price for r in got] == pytest.approx([10.0, 10.0, 0.0, 5.0]) and got[2].realised == pytest.approx(0.6)
