"""Costs, sizing, margin, risk rules and reports: row expressions and running windows over fills and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators.recursive import ordered_fold
from sandpiper.operators.rolling import ratio

EPS = 1e-12


def commission(kind: Column, rate: Column, lots: Column, notional: Column, minimum: Column) -> Column:
    """fixed, per_lot or percent_notional, never below the minimum; another kind is null."""
    raw = F.when(kind == "fixed", rate).when(kind == "per_lot", rate * lots).when(kind == "percent_notional", rate / 100 * notional)
    return F.when(raw.isNotNull(), F.greatest(raw, minimum))


def fill_costs(fills: DataFrame, contract: float = 1.0) -> DataFrame:
    """Executable price, slippage, spread and commission of fills (side 1 or -1, lots, bid, ask, slippage, commission_*)."""
    buy = F.col("side") == 1
    market = F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    out = fills.withColumns({"market_price": market, "fill_price": market + F.col("side") * F.col("slippage"), "spread_cost": (F.col("ask") - F.col("bid")) / 2 * F.col("lots") * contract, "slippage_cost": F.col("slippage") * F.col("lots") * contract})
    notional = F.col("fill_price") * F.col("lots") * contract
    out = out.withColumn("commission", commission(F.col("commission_kind"), F.col("commission_rate"), F.col("lots"), notional, F.col("commission_minimum")))
    return out.withColumn("total_cost", F.col("spread_cost") + F.col("slippage_cost") + F.col("commission"))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Cost by execution_id on both sides, their difference, and which side is missing."""
    side = lambda df, name: df.groupBy("execution_id").agg(F.sum("total_cost").alias(name), F.count("*").alias(f"{name}_fills"))
    both = side(expected, "expected").join(side(actual, "actual"), "execution_id", "full_outer")
    status = F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").otherwise("matched")
    return both.select("execution_id", F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual"), (F.coalesce("actual", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0))).alias("variance"), status.alias("status"))


def classify(old: Column, new: Column) -> Column:
    """What a change of signed position is."""
    return (
        F.when(old == new, "HOLD").when(old == 0, "OPEN").when(new == 0, "CLOSE").when(F.signum(old) != F.signum(new), "REVERSE").when(F.abs(new) > F.abs(old), "INCREASE").otherwise("REDUCE")
    )


def positions(fills: DataFrame, by: tuple[str, ...], time: list[str]) -> DataFrame:
    """Running signed position and cash of fills (side, lots, fill_price, commission), and what each fill did.

    time should leave no ties between fills that differ: each window would take those in an order of its own.
    """
    order = Window.partitionBy(*by).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    signed = F.col("side") * F.col("lots")
    out = fills.withColumns({"position": F.sum(signed).over(order), "cash": F.sum(-signed * F.col("fill_price") - F.col("commission")).over(order)})
    out = out.withColumn("action", classify(F.col("position") - signed, F.col("position")))
    return out.withColumn("equity", F.col("cash") + F.col("position") * F.col("fill_price"))


def drawdown(df: DataFrame, by: tuple[str, ...], time: list[str], equity: str = "equity") -> DataFrame:
    """Peak so far, total drawdown from it, and the day's drawdown from its first equity."""
    upto = Window.partitionBy(*by).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy(*by, F.to_date(time[0])).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"peak": F.max(equity).over(upto), "day_start": F.first(equity).over(day)})
    return out.withColumns({"total_drawdown": F.greatest(F.lit(0.0), ratio(F.col("peak") - F.col(equity), F.col("peak"))), "daily_drawdown": F.greatest(F.lit(0.0), ratio(F.col("day_start") - F.col(equity), F.col("day_start")))})


def sizing(df: DataFrame, contract: float = 1.0, leverage: float = 30.0) -> DataFrame:
    """lots for an exposure of equity, their margin; lots by stop loss for a share of equity at risk; the smaller one."""
    lots = ratio(F.col("equity") * F.col("exposure"), F.col("price") * contract)
    distance = F.abs(F.col("price") - F.col("stop_price"))
    by_stop = ratio(F.col("equity") * F.col("risk"), distance * contract)
    out = df.withColumns({"lots": lots, "loss_per_lot": distance * contract, "stop_lots": by_stop})
    out = out.withColumn("final_lots", F.least("lots", "stop_lots"))
    return out.withColumn("margin", F.col("final_lots") * contract * F.col("price") / leverage)


def normalise_lots(lots: Column, least: float, step: float, most: float) -> Column:
    """Clamped and rounded to the step, halves to even, four decimals."""
    return F.when(lots.isNotNull(), F.round(F.bround(F.greatest(F.lit(least), F.least(F.lit(most), lots)) / step) * step, 4))


def guard(equity: Column, free: Column, used: Column, level: Column, most_used: float = 0.5, least_level: float = 1.5) -> Column:
    """The first hard rule an account breaks, in order; null if none."""
    return (
        F.when(equity <= 0, "EQUITY_NOT_POSITIVE").when(free < 0, "NO_FREE_MARGIN").when(used < 0, "BAD_USED_MARGIN").when(ratio(used, equity) > most_used, "MARGIN_UTILISATION").when(level < least_level, "MARGIN_LEVEL")
    )


def risk_limits(df: DataFrame, by: str, symbol_cap: float = 0.3, total_cap: float = 1.0) -> DataFrame:
    """Requested exposures clipped to a cap for each symbol, then scaled down to a total for each decision, signs kept."""
    capped = F.signum("exposure") * F.least(F.abs("exposure"), F.lit(symbol_cap))
    out = df.withColumn("capped", capped)
    sum_ = F.sum(F.abs("capped")).over(Window.partitionBy(by))
    out = out.withColumn("final", F.when(sum_ > total_cap, F.col("capped") * total_cap / sum_).otherwise(F.col("capped")))
    return out.withColumn("status", F.when(F.col("final") == F.col("exposure"), "approved").otherwise("modified"))


def report(trades: DataFrame, by: tuple[str, ...], time: list[str], pnl: str = "pnl") -> DataFrame:
    """Total, mean, trades, win rate, profit factor, Sharpe, maximal drawdown and turnover a day of each group."""
    order = Window.partitionBy(*by).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("__eq", F.sum(pnl).over(order)).withColumn("__peak", F.max("__eq").over(order))
    gain, loss = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), -F.sum(F.when(F.col(pnl) < 0, F.col(pnl)).otherwise(0.0))
    return rows.groupBy(*by).agg(
        F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"), F.count("*").alias("trades"), F.avg((F.col(pnl) > 0).cast("int")).alias("win_rate"),
        ratio(gain, loss).alias("profit_factor"), (F.avg(pnl) / (F.stddev_samp(pnl) + EPS) * F.sqrt(F.count("*"))).alias("sharpe"),
        (F.max(F.col("__peak") - F.col("__eq")) / F.greatest(F.lit(1.0), F.abs(F.max("__peak")))).alias("max_drawdown"),
        (F.count("*") / F.count_distinct(F.to_date(time[0]))).alias("trades_per_day"),
    )


def top_zones(zones: DataFrame, by: str, k: int, least_members: int = 1) -> DataFrame:
    """The k best zones of a group by score, then the lower price."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "price")
    return zones.filter(F.col("members") >= least_members).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Default profiles (those for any symbol) that are broadcast at most; more are joined by shuffle.
DEFAULTS_LIMIT = 100_000


def resolve_commission(requests: DataFrame, profiles: DataFrame, strict: bool = False) -> DataFrame:
    """For every (broker, account_type, symbol) the most specific profile: its symbol, then the account's default, then the global one.

    profiles: (broker, account_type, symbol, kind, rate, round_turn), ``*`` standing for any. A round-turn rate is halved. A
    request that nothing fits has a null rate, or is an error if strict. Each request looks its four keys of broker and type up, with its symbol and
    among the defaults; all of it is by equality.
    """
    ways = [(b, t) for b in (True, False) for t in (True, False)]
    key = F.array(*(F.struct((F.col("broker") if b else F.lit("*")).alias("p_broker"), (F.col("account_type") if t else F.lit("*")).alias("p_type"), F.lit(2 * b + t).alias("score")) for b, t in ways))
    asked = requests.select("broker", "account_type", "symbol").distinct()
    keys = asked.withColumn("k", F.explode(key)).select("broker", "account_type", "symbol", "k.*")
    rate = F.when(F.col("round_turn"), F.col("rate") / 2).otherwise(F.col("rate"))
    known = profiles.select(F.col("broker").alias("p_broker"), F.col("account_type").alias("p_type"), F.col("symbol").alias("p_symbol"), F.struct("kind", rate.alias("rate")).alias("p"))
    defaults = known.filter("p_symbol = '*'").drop("p_symbol")
    few = defaults.limit(DEFAULTS_LIMIT + 1).count() <= DEFAULTS_LIMIT
    named = keys.join(known.withColumnRenamed("p_symbol", "symbol"), ["p_broker", "p_type", "symbol"]).withColumn("score", F.col("score") + 4)
    plain = keys.join(F.broadcast(defaults) if few else defaults, ["p_broker", "p_type"])
    best = named.unionByName(plain).groupBy("broker", "account_type", "symbol").agg(F.max_by("p", "score").alias("p"))
    out = asked.join(best, ["broker", "account_type", "symbol"], "left").select("broker", "account_type", "symbol", "p.kind", "p.rate")
    if not strict:
        return out
    missing = F.raise_error(F.concat(F.lit("no commission profile for "), F.concat_ws(" ", "broker", "account_type", "symbol"))).cast("double")
    return out.withColumn("rate", F.coalesce("rate", missing))


def slippage(df: DataFrame, mean_pips: float, std_pips: float, cap_pips: float, pip: float, seed: int = 7, key: str = "execution_id") -> DataFrame:
    """A normal slippage within 0 .. cap for every event, the same whenever the event is seen again: two uniforms read off an MD5 make it."""
    digest = lambda salt: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string")))
    u = lambda salt: (F.conv(F.substring(digest(salt), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    pips = F.greatest(F.lit(0.0), F.least(F.lit(cap_pips), mean_pips + std_pips * normal))
    return df.withColumns({"slippage_pips": pips, "slippage": pips * pip})


def correlation_cap(allocations: DataFrame, pairs: DataFrame, by: str, most: float = 0.8, joint: float = 0.4) -> DataFrame:
    """Pairs of one decision whose correlation is over ``most`` are scaled down to ``joint`` together, pair after pair in name order.

    Later pairs see what earlier ones left, so each decision's few pairs are folded in order.
    """
    legs = allocations.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "exposure")))).alias("x"))
    hot = pairs.filter((F.abs("rho") > most) & (F.col("symbol_a") < F.col("symbol_b")))
    folded = legs.join(hot.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("symbol_a", "symbol_b"))).alias("hot")), by, "left")

    def scale(state: Column, pair: Column) -> Column:
        together = F.abs(F.coalesce(state[pair["symbol_a"]], F.lit(0.0))) + F.abs(F.coalesce(state[pair["symbol_b"]], F.lit(0.0)))
        k = F.when(together > joint, joint / together).otherwise(1.0)
        return F.transform_values(state, lambda s, v: F.when(s.isin(pair["symbol_a"], pair["symbol_b"]), v * k).otherwise(v))

    out = folded.withColumn("y", F.aggregate(F.coalesce("hot", F.array().cast("array<struct<symbol_a:string,symbol_b:string>>")), F.col("x"), scale))
    return out.select(by, F.explode("y").alias("symbol", "capped"))


def intents(df: DataFrame, contract: float = 1.0) -> DataFrame:
    """Side and lots to trade from the position held to the exposure wanted."""
    want = ratio(F.col("equity") * F.col("exposure"), F.col("price") * contract)
    out = df.withColumns({"target_lots": want, "delta": want - F.col("held")})
    return out.withColumns({"side": F.signum("delta").cast("int"), "trade_lots": F.abs("delta"), "action": classify(F.col("held"), F.col("target_lots"))})


def flag_rate_proposals(df: DataFrame, flags: list[str], low: float, high: float, step: float) -> DataFrame:
    """For every flag its rate and whether its threshold should loosen (too rare), tighten (too common) or stay."""
    parts = F.array(*(F.struct(F.lit(f).alias("flag"), F.avg(f).alias("rate")) for f in flags))
    rows = df.agg(parts.alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return rows.withColumn("shift", F.when(F.col("rate") < low, -step).when(F.col("rate") > high, step).otherwise(0.0))


def simulate(fills: DataFrame, by: tuple[str, ...], order: tuple[str, ...], balance: float = 0.0) -> DataFrame:
    """Net position after each fill (side, lots, fill_price, commission), its mean entry price (0 when flat), the profit the fill
    realises, and the balance. Adding to a position averages its entry; what closes is settled against the entry; a
    reversal starts anew at the fill's price. Lots count to ten places, so that fills which cancel leave nothing. One account's fills are
    folded in order."""

    def step(rows):
        held = entry = 0.0
        for side, lots, price in rows:
            change = side * lots
            if held * change >= 0:
                entry = (abs(held) * entry + lots * price) / (abs(held) + lots) if lots else entry
                gain = 0.0
            else:
                gain = (price - entry) * (min(abs(held), lots) if held > 0 else -min(abs(held), lots))
                entry = price if lots > abs(held) else entry if lots < abs(held) else 0.0
            held = round(held + change, 10)
            entry = entry if held else 0.0
            yield held, entry, gain

    out = ordered_fold(fills, ["side", "lots", "fill_price"], ["held", "entry_price", "realised"], step, by, order)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("balance", balance + F.sum(F.col("realised") - F.col("commission")).over(upto))


def mark_to_market(df: DataFrame, bid: str = "bid", ask: str = "ask") -> DataFrame:
    """What held positions would realise now: long at the bid, short at the ask; equity is the balance and that."""
    price = F.when(F.col("held") >= 0, F.col(bid)).otherwise(F.col(ask))
    out = df.withColumn("unrealised", F.when(F.col("held") == 0, 0.0).otherwise((price - F.col("entry_price")) * F.col("held")))
    return out.withColumn("equity", F.col("balance") + F.col("unrealised"))


def decide(requests: DataFrame, by: str, symbol_cap: float = 0.3, total_cap: float = 1.0, leverage: float = 30.0, most_margin: float = 0.02) -> DataFrame:
    """The whole chain of a decision over its symbols (exposure, equity, free_margin, used_margin, margin_level).

    A hard rule broken rejects the decision (all exposures 0); else exposures are clipped by symbol, scaled to the total, and
    scaled again until the margin they need is at most ``most_margin`` of the free margin. verdict: REJECTED, MODIFIED or APPROVED.
    """
    checked = requests.withColumn("violation", guard(F.col("equity"), F.col("free_margin"), F.col("used_margin"), F.col("margin_level")))
    limited = risk_limits(checked, by, symbol_cap, total_cap)
    need = F.sum(F.abs("final") * F.col("equity") / leverage).over(Window.partitionBy(by))
    room = F.col("free_margin") * most_margin
    out = limited.withColumn("final", F.when(F.col("violation").isNotNull(), 0.0).when(need > room, F.col("final") * room / need).otherwise(F.col("final")))
    verdict = F.when(F.col("violation").isNotNull(), "REJECTED").when(F.col("final") == F.col("exposure"), "APPROVED").otherwise("MODIFIED")
    return out.withColumn("verdict", verdict).drop("status", "capped")


def observed_slippage(fills: DataFrame, cap: float) -> DataFrame:
    """Of broker fills (side, bid, ask, fill_price): market_price, adverse slippage (0 where the fill was better) and cap_exceeded; the fill is never altered."""
    market = F.when(F.col("side") > 0, F.col("ask")).otherwise(F.col("bid"))
    out = fills.withColumn("market_price", market)
    out = out.withColumn("slippage", F.greatest(F.lit(0.0), F.signum(F.col("side").cast("double")) * (F.col("fill_price") - F.col("market_price"))))
    return out.withColumn("cap_exceeded", F.coalesce((F.col("slippage") > cap).cast("int"), F.lit(0)))


def round_trip(entries: DataFrame, exits: DataFrame, by: str = "trade_id") -> DataFrame:
    """entry_cost, exit_cost and round_trip_cost of trades that have both sides (by, symbol, lots, total_cost; one row each); unequal lots or symbols are an error."""
    out = entries.select(by, "symbol", "lots", F.col("total_cost").alias("entry_cost")).join(exits.select(by, F.col("symbol").alias("__s"), F.col("lots").alias("__l"), F.col("total_cost").alias("exit_cost")), by)
    same = F.col("symbol").eqNullSafe(F.col("__s")) & F.col("lots").eqNullSafe(F.col("__l"))
    total = F.when(same, F.col("entry_cost") + F.col("exit_cost")).otherwise(F.raise_error(F.lit("entry and exit must have the same symbol and lots")).cast("double"))
    return out.withColumn("round_trip_cost", total).drop("__s", "__l")


def acceptance(reports: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """failed_gates: the names of metrics below their least or above their most, in the order given, comma-separated; accepted: 1 where there are none. A null metric counts as 0."""
    value = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    tests = [F.when(value(n) < v, F.lit(n)) for n, v in least.items()] + [F.when(value(n) > v, F.lit(n)) for n, v in most.items()]
    out = reports.withColumn("failed_gates", F.concat_ws(",", *tests))
    return out.withColumn("accepted", (F.col("failed_gates") == "").cast("int"))


def stop_alignment(df: DataFrame, eps: float = 1e-12) -> DataFrame:
    """stop_problem of every wanted exposure with a stop_price: flat (nothing to protect), long_stop_not_below or short_stop_not_above its price; null if sound or without a stop."""
    side = F.when(F.abs("exposure") <= eps, 0).otherwise(F.signum("exposure"))
    wrong = F.when(side == 0, "flat").when((side > 0) & (F.col("stop_price") >= F.col("price")), "long_stop_not_below").when((side < 0) & (F.col("stop_price") <= F.col("price")), "short_stop_not_above")
    return df.withColumn("stop_problem", F.when(F.col("stop_price").isNotNull(), wrong))


def stop_caps(df: DataFrame, contract: float = 1.0) -> DataFrame:
    """capped_exposure and stop_capped (0/1): an exposure that needs more lots than its stop's loss budget allows is scaled down to them.

    The lots are those of sizing(); rows without a stop, and flat ones, stay as they are.
    """
    sized = sizing(df.withColumns({"__e": F.col("exposure"), "exposure": F.abs("exposure")}), contract)
    over = F.coalesce((F.abs("__e") > 1e-12) & (F.col("lots") > F.col("stop_lots")), F.lit(False))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("stop_lots") / F.col("lots")))
    out = sized.withColumns({"capped_exposure": F.when(over, F.col("__e") * share).otherwise(F.col("__e")), "stop_capped": over.cast("int"), "exposure": F.col("__e")})
    return out.select(*df.columns, "capped_exposure", "stop_capped")


def modifications(df: DataFrame, by: str, changes: dict[str, tuple[str, str]]) -> DataFrame:
    """(by, symbol, code, requested, final) for every change that a rule made: changes maps the rule's code to the columns before and after it."""
    each = F.array(*(F.struct(F.lit(code).alias("code"), F.col(a).alias("requested"), F.col(b).alias("final")) for code, (a, b) in changes.items()))
    return df.select(by, "symbol", F.explode(each).alias("m")).select(by, "symbol", "m.*").filter(~F.col("requested").eqNullSafe(F.col("final")))


def resize(df: DataFrame, by: str, values: str, reference: str, out: str = "resized") -> DataFrame:
    """The values of a group scaled to the total of its reference values; negative ones count as 0, and so does all without a total."""
    whole = Window.partitionBy(by)
    positive = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    have, want = F.sum(positive(values)).over(whole), F.sum(positive(reference)).over(whole)
    return df.withColumn(out, F.when((have > 0) & (want > 0), positive(values) * want / have).otherwise(0.0))


def affordable_lots(wanted: Column, free: Column, margin_per_lot: Column, least: float, step: float, most: float) -> Column:
    """The wanted lots, normalised, or the most steps whose margin the free margin covers; 0 where not even the least is."""
    want = normalise_lots(wanted, least, step, most)
    room = F.round(F.floor(free / margin_per_lot / step + 1e-9) * step, 4)
    fits = F.when(want * margin_per_lot <= free, want).otherwise(F.least(want, room))
    return F.when((free <= 0) | (wanted <= 0) | (fits < least), 0.0).otherwise(fits)
