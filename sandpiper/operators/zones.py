"""Breakers, the status of recent zones, and one support/resistance score from several kinds of zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators.patterns import flag
from sandpiper.operators.recursive import recur, smooth
from sandpiper.operators.rolling import prev, ratio
from sandpiper.sources.candles import series


def breaker(df: DataFrame, bottom: str = "ob_bottom", top: str = "ob_top", lookback: int = 5) -> DataFrame:
    """bf: on the bar after a close beyond a zone of the ``lookback`` bars before (1 above, -1 below); bf_bottom and bf_top are the breaking bar's body."""
    past = series().rowsBetween(-lookback, -1)
    kind = F.when(F.col("close") > F.min(top).over(past), 1).when(F.col("close") < F.max(bottom).over(past), -1).otherwise(0)
    out = df.withColumn("__k", kind)
    body = lambda pick: F.when(F.col("__k") != 0, pick("open", "close"))
    return out.withColumns({"bf": F.coalesce(prev("__k"), F.lit(0)), "bf_bottom": body(F.least), "bf_top": body(F.greatest)}).drop("__k")


def zone_status(df: DataFrame, name: str, bottom: str, top: str, life: int = 3, atr: str = "atr", size_weight: float = 0.5, age_weight: float = 0.3) -> DataFrame:
    """Columns name_alive, _filled, _expired, _active_top, _active_bottom, _age, _score for the zones of the ``life`` bars before.

    filled: the bar reaches into one of them; alive: there is one and none is reached; expired: the oldest leaves the span
    unreached. active_top, active_bottom and age are the newest zone's while alive. The score adds its size in ATR and its freshness,
    1 / (1 + age), by weight; 0 without a zone. Touches earn nothing: a touched zone is not alive.
    """
    past = [(prev(top, k), prev(bottom, k)) for k in range(1, life + 1)]
    exists = [t.isNotNull() & b.isNotNull() for t, b in past]
    reached = [flag((F.col("low") <= t) & (F.col("high") >= b)) for t, b in past]
    any_of = lambda tests: F.greatest(*tests, F.lit(0))
    age = F.coalesce(*(F.when(e, k) for k, e in enumerate(exists, 1)))
    out = df.withColumns({"__hit": any_of(reached), "__age": age, "__old": flag(exists[-1])})
    alive = (F.col("__hit") == 0) & F.col("__age").isNotNull()
    at = lambda side: F.when(alive, F.coalesce(*(F.when(F.col("__age") == k, pair[side]) for k, pair in enumerate(past, 1))))
    out = out.withColumns({f"{name}_alive": flag(alive), f"{name}_filled": F.col("__hit"), f"{name}_expired": flag((F.col("__old") == 1) & (F.col("__hit") == 0)), f"{name}_active_top": at(0), f"{name}_active_bottom": at(1), f"{name}_age": F.when(alive, F.col("__age"))})
    size = F.coalesce(ratio(F.abs(F.col(f"{name}_active_top") - F.col(f"{name}_active_bottom")), F.col(atr)), F.lit(0.0))
    score = F.when(F.col(f"{name}_alive") == 1, size_weight * size + age_weight / (1 + F.col(f"{name}_age"))).otherwise(0.0)
    return out.withColumn(f"{name}_score", score).drop("__hit", "__age", "__old")


def hysteresis(value: Column, enter: float, leave: float) -> Column:
    """1 from where the value reaches ``enter`` until it falls below ``leave``, else 0; a null value changes nothing."""
    event = F.when(value >= enter, 1).when(value < leave, 0)
    return F.coalesce(F.last(event, True).over(series().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def fusion(df: DataFrame, names: list[str], span: int = 5, age_norm: float = 5.0, enter: float = 0.55, leave: float = 0.35, cooldown: int = 3, least: float = 0.3, tie: float = 0.02, confirm: str | None = None) -> DataFrame:
    """sr_score_raw, sr_on, sr_score, sr_top, sr_bottom, sr_source from the columns of zone_status() for every name.

    Each score is smoothed exponentially, decays with its zone's age, and is 0 without a living zone, for ``cooldown`` bars
    after a fill or expiry, and where ``confirm`` (a 0/1 column) is not 1. raw is the largest; among those within ``tie``
    of it the youngest living zone's wins, then the first named. on starts at ``enter`` and ends below ``leave``, neither
    below ``least``; while off, score is 0 and the rest null.
    """
    if leave > enter:
        raise ValueError("leave is above enter")
    out = recur(df, **{f"__e_{n}": smooth(F.coalesce(F.col(f"{n}_score"), F.lit(0.0)), 2 / (span + 1)) for n in names})
    lately = series().rowsBetween(-(cooldown - 1), 0)
    allowed = F.lit(True) if confirm is None else F.coalesce(F.col(confirm).cast("int") == 1, F.lit(False))
    for n in names:
        cool = F.max(F.greatest(f"{n}_filled", f"{n}_expired")).over(lately)
        out = out.withColumn(f"__s_{n}", F.when((F.col(f"{n}_alive") == 1) & (cool == 0) & allowed, F.col(f"__e_{n}") / (1 + F.coalesce(F.col(f"{n}_age"), F.lit(0)) / age_norm)).otherwise(0.0))
    out = out.withColumn("sr_score_raw", F.greatest(*(f"__s_{n}" for n in names), F.lit(0.0)))
    ranked = F.array(*(F.when(F.col("sr_score_raw") - F.col(f"__s_{n}") <= tie, F.struct((1 - F.col(f"{n}_alive")).alias("idle"), F.coalesce(F.col(f"{n}_age"), F.lit(0)).alias("age"), F.lit(k).alias("k"))) for k, n in enumerate(names)))
    out = out.withColumns({"__best": F.array_min(ranked)["k"], "sr_on": hysteresis(F.col("sr_score_raw"), max(enter, least), max(leave, least))})
    on = F.col("sr_on") == 1
    of = lambda side: F.when(on, F.element_at(F.array(*(F.col(f"{n}_{side}") for n in names)), F.col("__best") + 1))
    out = out.withColumns({"sr_score": F.when(on, F.col("sr_score_raw")).otherwise(0.0), "sr_top": of("active_top"), "sr_bottom": of("active_bottom"), "sr_source": F.when(on, F.element_at(F.array(*map(F.lit, names)), F.col("__best") + 1))})
    return out.drop("__best", *(f"__{x}_{n}" for n in names for x in "es"))
