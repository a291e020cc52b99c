"""Zigzag by depth, deviation and backstep: its swings, legs, the levels that legs give, and how bars of another timeframe see them.

All of it is windows. A swing may still move until the bar in zz_confirmed; whoever must not look ahead uses swings from that
bar on only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.operators.rolling import frame, prev, ratio
from sandpiper.sources.candles import KEY, series

EVER = "TIMESTAMP_NTZ'9999-12-31 00:00:00'"


def _upto(end: int = 0):
    return series().rowsBetween(Window.unboundedPreceding, end)


def depth_swings(df: DataFrame, depth: int = 12, deviation: float = 5.0, backstep: int = 10) -> DataFrame:
    """zz_state (1 high, -1 low, 0), zz_price, zz_confirmed (time of the bar from which the swing stands; null until then) and
    zz_leg (what is sought: 1 the next high, -1 the next low, 0 before any swing).

    A bar is a candidate if its low (high) is the lowest (highest) of ``depth`` bars, unless one of the ``backstep`` bars
    after it, itself within ``deviation`` of its own extreme, sees a lower (higher) one. Candidates of one kind in a row
    are one swing, at the most extreme of them; a bar that is both kinds ends the row.
    """
    whole, ahead = frame(depth), series().rowsBetween(1, backstep)
    full = F.count("*").over(whole) == depth
    out = df.withColumns({"__lo": F.when(full, F.min("low").over(whole)), "__hi": F.when(full, F.max("high").over(whole))})
    under = F.min(F.when(F.col("low") - F.col("__lo") <= deviation, F.col("__lo"))).over(ahead)
    over = F.max(F.when(F.col("__hi") - F.col("high") <= deviation, F.col("__hi"))).over(ahead)
    out = out.withColumns({
        "__l": F.when((F.col("low") == F.col("__lo")) & ~F.coalesce(under < F.col("low"), F.lit(False)), F.col("low")),
        "__h": F.when((F.col("high") == F.col("__hi")) & ~F.coalesce(over > F.col("high"), F.lit(False)), F.col("high")),
    })
    both = F.col("__l").isNotNull() & F.col("__h").isNotNull()
    out = out.withColumn("__one", F.when(~both & F.col("__h").isNotNull(), 1).when(~both & F.col("__l").isNotNull(), -1))
    out = out.withColumn("__turns", F.sum(both.cast("int")).over(_upto()))
    since = F.col("__turns") - F.coalesce(F.last(F.when(F.col("__one").isNotNull(), F.col("__turns")), True).over(_upto()), F.lit(0))
    event = F.col("__l").isNotNull() | F.col("__h").isNotNull()
    # the first of all, if both, counts as a high
    kind = F.coalesce(F.last("__one", True).over(_upto()), F.lit(-1)) * F.when(since % 2 == 0, 1).otherwise(-1)
    out = out.withColumn("__kind", F.when(event, kind))
    out = out.withColumn("__was", F.last("__kind", True).over(_upto(-1)))
    out = out.withColumn("__new", (event & (F.col("__was").isNull() | (F.col("__was") != F.col("__kind")))).cast("int"))
    out = out.withColumn("__run", F.sum("__new").over(_upto()))
    best = Window.partitionBy(*KEY, "__run").orderBy(F.desc_nulls_last(F.when(F.col("__kind") == 1, F.col("high")).when(F.col("__kind") == -1, -F.col("low"))), "ts")
    out = out.withColumn("__pivot", F.row_number().over(best))
    swing = event & (F.col("__pivot") == 1)
    # from the end backwards, so that the frame grows and every bar is added once
    back = Window.partitionBy(*KEY).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.min(F.when(F.col("__new") == 1, F.col("ts"))).over(back)
    return out.withColumns({
        "zz_state": F.when(swing, F.col("__kind")).otherwise(0),
        "zz_price": F.when(swing, F.when(F.col("__kind") == 1, F.col("high")).otherwise(F.col("low"))),
        "zz_confirmed": F.when(swing, later),
        "zz_leg": -F.coalesce(F.col("__was"), F.lit(0)),
    }).drop("__lo", "__hi", "__l", "__h", "__one", "__turns", "__kind", "__was", "__new", "__run", "__pivot")


def depth_legs(swings: DataFrame) -> DataFrame:
    """(key, start_ts, end_ts, direction, start_price, end_price, confirmed): from swing to swing.

    Legs in a row that go the same way are one. confirmed: when the leg's end stands, null while it doesn't.
    """
    points = swings.filter("zz_state <> 0").select(*KEY, "ts", "zz_state", F.col("zz_price").alias("p"), "zz_confirmed")
    ahead = lambda c: F.lead(c).over(series())
    legs = points.withColumns({"end_ts": ahead("ts"), "end_price": ahead("p"), "end_state": ahead("zz_state"), "end_confirmed": ahead("zz_confirmed")}).filter("end_ts IS NOT NULL")
    legs = legs.withColumn("way", F.signum(F.col("end_price") - F.col("p")))
    legs = legs.withColumn("leg", F.sum(F.coalesce((F.col("way") != prev("way")).cast("int"), F.lit(1))).over(_upto()))
    last = lambda c: F.max_by(c, "ts")
    out = legs.groupBy(*KEY, "leg").agg(
        F.min("ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.when(F.count("*") == 1, F.max("end_state")).otherwise(F.max("way")).cast("int").alias("direction"),
        F.min_by("p", "ts").alias("start_price"), last("end_price").alias("end_price"), last("end_confirmed").alias("confirmed"),
    )
    return out.drop("leg")


def newest_legs(legs: DataFrame, most: int = 3, confirmed: bool = False) -> DataFrame:
    """The newest ``most`` legs of each series, numbered from the last (nth), as levels.fibonacci() and its kin take them; with ``confirmed`` of those whose end stands."""
    rows = legs.filter("confirmed IS NOT NULL") if confirmed else legs
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("end_ts")))).filter(F.col("nth") <= most)


def along_legs(df: DataFrame, legs: DataFrame, shift: str = "INTERVAL 0 MINUTE", extend: bool = False) -> DataFrame:
    """leg_dir, leg_mark, sr_support, sr_resistance on bars, of legs of the same or a longer timeframe.

    A swing belongs to the last bar that opens at or before it, moved on by ``shift``. leg_dir: direction of the leg that a
    bar is on, 0 outside; leg_mark: 1 at a swing high, -1 at a swing low. A rising leg's start is support, a falling one's resistance;
    with ``extend`` the last leg's direction and its end as a level go on. One union and one window, no range join.
    """
    moved = lambda c: F.expr(f"{c} + {shift}")
    none = F.lit(None).cast("double")
    starts = legs.select("symbol", moved("start_ts").alias("__at"), F.col("direction").alias("__dir"), (-F.col("direction")).alias("__mark"), F.when(F.col("direction") > 0, F.col("start_price")).alias("__sup"), F.when(F.col("direction") <= 0, F.col("start_price")).alias("__res"), F.lit(2).alias("__order"))
    after = lambda test: F.when(test, F.col("end_price")) if extend else none
    ends = legs.select("symbol", moved("end_ts").alias("__at"), (F.col("direction") if extend else F.lit(0)).alias("__dir"), F.col("direction").alias("__mark"), after(F.col("direction") < 0).alias("__sup"), after(F.col("direction") >= 0).alias("__res"), F.lit(1).alias("__order"))
    # a bar comes before the swings at the time it closes
    bars = df.withColumns({"__bar": F.lit(True), "__at": F.coalesce(F.lead("ts").over(series()), F.expr(EVER).cast(df.schema["ts"].dataType)), "__order": F.lit(0)})
    both = bars.unionByName(starts.unionByName(ends), allowMissingColumns=True)
    line = Window.partitionBy("symbol").orderBy("__at", "__order").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("__bar").isNull(), F.struct("__at", "__dir", "__mark", "__sup", "__res")), True).over(line)
    out = both.withColumn("__leg", here).filter("__bar")
    return out.withColumns({
        "leg_dir": F.coalesce(F.col("__leg.__dir"), F.lit(0)), "leg_mark": F.when(F.col("__leg.__at") >= F.col("ts"), F.col("__leg.__mark")).otherwise(0),
        "sr_support": F.col("__leg.__sup"), "sr_resistance": F.col("__leg.__res"),
    }).select(*df.columns, "leg_dir", "leg_mark", "sr_support", "sr_resistance")


def level_distance(df: DataFrame, atr: str = "atr", eps: float = 1e-8) -> DataFrame:
    """dist_to_support_norm, dist_to_resistance_norm: how far the close is from the levels, in ATR."""
    width = F.col(atr) + eps
    return df.withColumns({"dist_to_support_norm": ratio(F.col("close") - F.col("sr_support"), width), "dist_to_resistance_norm": ratio(F.col("sr_resistance") - F.col("close"), width)})


def swing_state(df: DataFrame, soft: tuple[str, ...] = ()) -> DataFrame:
    """pivot_age (bars since the last swing; -1 before any), pivot_price and pivot_distance (0 before any), and soft_strength: how many of the 0/1 columns ``soft`` speak for it."""
    out = df.withColumn("__n", F.row_number().over(series()))
    last = lambda c: F.last(F.when(F.col("zz_state") != 0, F.col(c)), True).over(_upto())
    out = out.withColumns({"__at": last("__n"), "__p": last("zz_price")})
    strength = F.lit(0)
    for c in soft:
        strength = strength + F.col(c)
    return out.withColumns({
        "pivot_age": F.coalesce(F.col("__n") - F.col("__at"), F.lit(-1)), "pivot_price": F.coalesce("__p", F.lit(0.0)),
        "pivot_distance": F.coalesce(F.abs(F.col("close") - F.col("__p")), F.lit(0.0)), "soft_strength": strength.cast("int"),
    }).drop("__n", "__at", "__p")


def regime_with_legs(df: DataFrame, up: str = "bos", turn: str = "choch", scale: str = "atr") -> DataFrame:
    """regime_pro: 1 from a bullish trigger on, -1 from a bearish one, 0 before any. A trigger is a break or turn of structure
    once ``scale`` has a value, or a leg (leg_dir) of the longer timeframe; on a bar with both the bullish one counts."""
    ready = F.col(scale).isNotNull()
    says = lambda way: (ready & ((F.col(up) == way) | (F.col(turn) == way))) | (F.col("leg_dir") == way)
    return df.withColumn("__t", F.when(says(1), 1).when(says(-1), -1)).withColumn("regime_pro", F.coalesce(F.last("__t", True).over(_upto()), F.lit(0))).drop("__t")
