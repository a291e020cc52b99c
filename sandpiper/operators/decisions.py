"""Portfolio decisions under risk limits, rule after rule: each rule sees the portfolio as the ones before it have left it.

A decision's symbols become one array, in name order; a rule is a transform of that array, and what the portfolio would then
hold (exposure, margin, positions) is an aggregate over it, worked out anew after every rule. So any number of decisions takes
one shuffle and no driver, and a task holds the symbols of one decision at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


@dataclass(frozen=True)
class Limits:
    """Exposures, allocations and risk are shares of equity; None: no limit."""

    total_exposure: float = 1.0
    symbol_exposure: float = 0.5
    symbol_concentration: float = 0.5
    margin_utilisation: float = 0.8
    drawdown: float = 0.2
    daily_drawdown: float = 0.05
    portfolio_risk: float = 0.5
    leverage: float | None = None
    correlation: float = 0.85
    correlated_exposure: float = 0.5
    open_positions: int | None = None
    positions_per_symbol: int | None = None

    def __post_init__(self) -> None:
        for name in ("total_exposure", "symbol_exposure", "symbol_concentration", "margin_utilisation", "drawdown", "daily_drawdown", "portfolio_risk", "correlation", "correlated_exposure"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be within 0 and 1")
        if self.leverage is not None and not 0 < self.leverage < float("inf"):
            raise ValueError("leverage must be above 0")
        for name in ("open_positions", "positions_per_symbol"):
            if (value := getattr(self, name)) is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                raise ValueError(f"{name} must be a whole number from 0 on")


#: Columns of a symbol's row. Those that may be missing, with what stands for them.
SYMBOL = {"target": None, "capital": 0.0, "margin": 0.0, "current": 0.0, "current_margin": 0.0, "positions": 0, "margin_rate": None, "stop_lots": None, "lot_value": None}
ACCOUNT = ("equity", "free_margin", "used_margin", "margin_level", "leverage", "drawdown", "daily_drawdown", "portfolio_risk", "blocked")
NOTE = "struct<code:string,symbol:string,severity:string>"
CHANGE = "struct<code:string,symbol:string,field:string,requested:double,final:double>"


def holds(s: Column) -> Column:
    """The exposure a symbol would have: its target, or what it has where none is asked."""
    return F.coalesce(s["target"], s["current"])


def margin_of(s: Column, equity: Column) -> Column:
    """By the instrument's margin rate where it is known, else what is used now, in proportion to the exposure."""
    size = F.abs(holds(s))
    scaled = F.when(F.abs(s["current"]) > EPS, s["current_margin"] * size / F.abs(s["current"])).otherwise(0.0)
    return F.when(size <= EPS, 0.0).otherwise(F.coalesce(size * equity * s["margin_rate"], scaled))


def positions_of(s: Column) -> Column:
    return F.when(F.abs(holds(s)) <= EPS, 0).when(F.abs(s["current"]) <= EPS, 1).otherwise(s["positions"])


def total(symbols: Column, of: Callable[[Column], Column], zero: Column | None = None) -> Column:
    return F.aggregate(symbols, F.lit(0.0) if zero is None else zero, lambda t, s: t + of(s))


def changed_by(code: str, before: Column, after: Column, fields: tuple[str, ...]) -> Column:
    """A row for every field of every symbol that a rule has changed."""
    rows = F.flatten(F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda z: F.array(*(F.struct(F.lit(code).alias("code"), z["a"]["symbol"].alias("symbol"), F.lit(f).alias("field"), z["a"][f].alias("requested"), z["b"][f].alias("final")) for f in fields))))
    return F.filter(rows, lambda r: ~r["requested"].eqNullSafe(r["final"])).cast(f"array<{CHANGE}>")


def note(code: str, symbol: Column | None = None, severity: str = "warning") -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"), F.lit(severity).alias("severity"))


def with_fields(s: Column, **values: Column) -> Column:
    for name, value in values.items():
        s = s.withField(name, value)
    return s


def cap(value: Column, limit: float) -> Column:
    return F.when(F.abs(value) > limit, F.signum(value) * limit).otherwise(value)


def evaluate(decisions: DataFrame, symbols: DataFrame, by: str, limits: Limits | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """by, verdict (APPROVED, MODIFIED, REJECTED), notes, changes, symbols (see targets()), exposure, margin, positions.

    decisions: a row for each, with the account as it stands (ACCOUNT). symbols: (by, symbol, target, and what else SYMBOL names); a symbol
    without a target keeps what it has. pairs: (by, symbol_a, symbol_b, rho).

    An account without usable capital, blocked, or at its drawdown, and a decision beyond the risk budget are rejected at once. Then, in this order:
    exposure of a symbol is capped; the total is scaled; pairs whose correlation is high are scaled together, in name order;
    capital is capped; exposure, capital and margin are scaled until the margin fits; exposures are capped by what their stop's
    loss budget allows (stop_lots, with lot_value a lot's worth). What is left is rejected if it needs too many positions or leaves no free margin. notes
    say which rules spoke, in that order; changes hold each rule's own change of each value. A rejected decision has no symbols, and the
    notes of the rules it had come through.
    """
    limits = limits or Limits()
    given = [F.coalesce(F.col(c).cast("double"), F.lit(d).cast("double")).alias(c) if c in symbols.columns else F.lit(d).cast("double").alias(c) for c, d in SYMBOL.items()]
    rows = symbols.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("symbol", *given))).alias("x0"))
    kind = rows.schema["x0"].dataType.simpleString()
    out = decisions.select(by, *ACCOUNT).join(rows, by, "left").withColumn("x0", F.coalesce("x0", F.array().cast(kind)))
    hot = F.array().cast("array<struct<a:string,b:string>>")
    if pairs is not None:
        high = pairs.filter((F.abs("rho") >= limits.correlation) & (F.col("symbol_a") < F.col("symbol_b")))
        out = out.join(high.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("symbol_a").alias("a"), F.col("symbol_b").alias("b")))).alias("hot")), by, "left")
        out = out.withColumn("hot", F.coalesce("hot", hot))
    else:
        out = out.withColumn("hot", hot)
    equity = F.col("equity")

    over = lambda value, limit: F.lit(False) if limit is None else value > limit
    guards = [
        ("NO_USABLE_CAPITAL", equity <= 0), ("INSUFFICIENT_FREE_MARGIN", F.col("free_margin") < 0), ("INVALID_MARGIN_LEVEL", (F.col("used_margin") > 0) & (F.col("margin_level") <= 0)),
        ("INVALID_LEVERAGE", F.col("leverage") <= 0), ("MAX_ACCOUNT_LEVERAGE", over(F.col("leverage"), limits.leverage)), ("RISK_BLOCKED", F.col("blocked")),
        ("MAX_DRAWDOWN", F.col("drawdown") >= limits.drawdown), ("MAX_DAILY_DRAWDOWN", F.col("daily_drawdown") >= limits.daily_drawdown), ("MAX_PORTFOLIO_RISK", F.col("portfolio_risk") > limits.portfolio_risk),
    ]
    guard = F.lit(None).cast("string")
    for code, broken in reversed(guards):
        guard = F.when(broken, code).otherwise(guard)
    out = out.withColumn("guard", guard)
    steps: list[tuple[str, str, str]] = []

    def rule(code: str, after: Column, notes: Callable[[Column, Column], Column], fields: tuple[str, ...] = ("target",)) -> None:
        """Adds x<k>, what the rule makes of x<k - 1>, its notes and its changes."""
        nonlocal out
        k = len(steps) + 1
        was, now = F.col(f"x{k - 1}"), F.col(f"x{k}")
        out = out.withColumn(f"x{k}", after.cast(kind))
        out = out.withColumns({f"n{k}": notes(was, now).cast(f"array<{NOTE}>"), f"c{k}": changed_by(code, was, now, fields)})
        steps.append((f"x{k}", f"n{k}", f"c{k}"))

    def each(code: str, field: str) -> Callable[[Column, Column], Column]:
        """A note for each symbol whose field has changed."""
        return lambda was, now: F.transform(F.filter(F.arrays_zip(was.alias("a"), now.alias("b")), lambda z: ~z["a"][field].eqNullSafe(z["b"][field])), lambda z: note(code, z["a"]["symbol"]))

    def once(code: str, test: Column) -> Callable[[Column, Column], Column]:
        return lambda was, now: F.when(test, F.array(note(code))).otherwise(F.array().cast(f"array<{NOTE}>"))

    x = lambda: F.col(f"x{len(steps)}")
    rule("MAX_SYMBOL_EXPOSURE", F.transform(x(), lambda s: with_fields(s, target=cap(s["target"], limits.symbol_exposure))), each("MAX_SYMBOL_EXPOSURE", "target"))

    out = out.withColumn("t", total(x(), lambda s: F.abs(holds(s))))
    beyond = F.col("t") > limits.total_exposure
    rule("MAX_TOTAL_EXPOSURE", F.when(beyond, F.transform(x(), lambda s: with_fields(s, target=s["target"] * limits.total_exposure / F.col("t")))).otherwise(x()), once("MAX_TOTAL_EXPOSURE", beyond))

    # pair after pair: a later pair sees what earlier ones have left
    def both(symbols: Column, pair: Column) -> Column:
        return total(symbols, lambda s: F.when(s["symbol"].isin(pair["a"], pair["b"]), F.abs(F.coalesce(s["target"], F.lit(0.0)))).otherwise(0.0))

    def scaled(state: Column, pair: Column) -> Column:
        together = both(state["x"], pair)
        less = F.transform(state["x"], lambda s: with_fields(s, target=F.when(s["symbol"].isin(pair["a"], pair["b"]), s["target"] * limits.correlated_exposure / together).otherwise(s["target"])))
        hit = together > limits.correlated_exposure
        return F.struct(F.when(hit, less).otherwise(state["x"]).alias("x"), (state["n"] + hit.cast("int")).alias("n"))

    out = out.withColumn("pairs", F.aggregate("hot", F.struct(x().alias("x"), F.lit(0).alias("n")).cast(f"struct<x:{kind},n:int>"), lambda s, p: scaled(s, p).cast(f"struct<x:{kind},n:int>")))
    rule("MAX_CORRELATED_EXPOSURE", F.col("pairs.x"), lambda was, now: F.transform(F.sequence(F.lit(0), F.col("pairs.n")), lambda i: F.when(i > 0, note("MAX_CORRELATED_EXPOSURE"))))
    out = out.withColumn(steps[-1][1], F.filter(steps[-1][1], lambda n: n.isNotNull()))
    rule("MAX_SYMBOL_CONCENTRATION", F.transform(x(), lambda s: with_fields(s, capital=F.when(s["target"].isNotNull(), cap(s["capital"], limits.symbol_concentration)).otherwise(s["capital"]))), each("MAX_SYMBOL_CONCENTRATION", "capital"), ("capital",))

    out = out.withColumn("m", total(x(), lambda s: margin_of(s, equity)))
    beyond = (equity > 0) & (F.col("m") > 0) & (F.col("m") / equity > limits.margin_utilisation)
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.0), limits.margin_utilisation * equity / F.col("m")))
    less = F.transform(x(), lambda s: F.when(s["target"].isNull(), s).otherwise(with_fields(s, target=s["target"] * factor, capital=s["capital"] * factor, margin=s["margin"] * factor)))
    rule("MAX_MARGIN_UTILISATION", F.when(beyond, less).otherwise(x()), once("MAX_MARGIN_UTILISATION", beyond), ("target", "capital", "margin"))

    def stopped(s: Column) -> Column:
        lots = F.abs(s["target"]) * equity / s["lot_value"]
        return F.when((F.abs(s["target"]) > EPS) & (lots > s["stop_lots"]) & (lots > 0), s["target"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["stop_lots"] / lots))).otherwise(s["target"])

    rule("STOP_LOSS_RISK_CAP", F.transform(x(), lambda s: with_fields(s, target=stopped(s))), each("STOP_LOSS_RISK_CAP", "target"))

    out = out.withColumns({"exposure": total(x(), lambda s: F.abs(holds(s))), "margin": total(x(), lambda s: margin_of(s, equity)), "positions": total(x(), positions_of).cast("int")})
    crowded = F.filter(x(), lambda s: over(positions_of(s), limits.positions_per_symbol))
    refused = F.when(over(F.col("positions"), limits.open_positions), note("MAX_OPEN_POSITIONS", severity="critical")).when(F.size(crowded) > 0, note("MAX_POSITIONS_PER_SYMBOL", F.get(crowded, F.lit(0))["symbol"], "critical")).when(equity - F.col("margin") <= 0, note("NO_FREE_MARGIN", severity="critical"))
    out = out.withColumn("refused", refused.cast(NOTE))
    out = out.withColumns({"warned": F.concat(*(n for _, n, _ in steps)), "changed": F.concat(*(c for _, _, c in steps))})
    early, late = F.col("guard").isNotNull(), F.col("refused").isNotNull()
    critical = F.array(F.struct(F.col("guard").alias("code"), F.lit(None).cast("string").alias("symbol"), F.lit("critical").alias("severity"))).cast(f"array<{NOTE}>")
    none = F.array()
    verdict = F.when(early | late, "REJECTED").when(F.size("warned") > 0, "MODIFIED").otherwise("APPROVED")
    return out.select(
        by, verdict.alias("verdict"), F.when(early, critical).when(late, F.concat("warned", F.array("refused"))).otherwise(F.col("warned")).alias("notes"),
        F.when(early, none.cast(f"array<{CHANGE}>")).otherwise(F.col("changed")).alias("changes"), F.when(early | late, none.cast(kind)).otherwise(F.filter(x(), lambda s: s["target"].isNotNull())).alias("symbols"), "exposure", "margin", "positions",
    )


def targets(evaluated: DataFrame, by: str) -> DataFrame:
    """(by, symbol, target, capital, margin) of what the decisions come to; none of a rejected one."""
    return evaluated.select(by, F.explode("symbols").alias("s")).select(by, "s.symbol", "s.target", "s.capital", "s.margin")


def audit(evaluated: DataFrame, by: str) -> DataFrame:
    """(by, step, code, symbol, field, requested, final): every change that a rule made, in order; step counts from 1 within a decision."""
    return evaluated.select(by, F.posexplode("changes").alias("step", "c")).select(by, (F.col("step") + 1).alias("step"), "c.*")
