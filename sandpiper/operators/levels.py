"""Price levels: Fibonacci levels of swings and their clusters, overlap with support and resistance, life of zones, bias."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sandpiper.operators.blocks import BLOCK, OWN, block_of
from sandpiper.operators.recursive import rolling_quantiles
from sandpiper.operators.rolling import frame, prev, ratio
from sandpiper.session import ship
from sandpiper.sources.candles import KEY, series

#: Fixed ratios of retracements and extensions.
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.272, 1.618, 2.0)


def legs(swings: DataFrame, swing: str = "zz", price: str = "zz_price") -> DataFrame:
    """Confirmed swings in a row as legs: start_ts, end_ts, start_price, end_price, direction, nth (newest is 1)."""
    rows = swings.filter(F.col(swing) != 0)
    out = rows.select(*KEY, prev("ts").alias("start_ts"), F.col("ts").alias("end_ts"), prev(price).alias("start_price"), F.col(price).alias("end_price"), F.col(swing).cast("int").alias("direction")).filter("start_ts IS NOT NULL")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("end_ts"))))


def fibonacci(leg_rows: DataFrame, ratios: tuple[float, ...] = RETRACEMENTS) -> DataFrame:
    """A row for each leg and ratio: the price that takes the ratio of the leg back from its end."""
    r = F.explode(F.array(*map(F.lit, ratios))).alias("ratio")
    out = leg_rows.select(*leg_rows.columns, r)
    return out.withColumn("level", F.col("end_price") - F.col("ratio") * (F.col("end_price") - F.col("start_price")))


def golden_zone(leg_rows: DataFrame, low: float = 0.382, high: float = 0.618) -> DataFrame:
    """Of each series' newest leg the zone between two ratios, its centre, and its width in percent of it."""
    a = F.col("end_price") - low * (F.col("end_price") - F.col("start_price"))
    b = F.col("end_price") - high * (F.col("end_price") - F.col("start_price"))
    out = leg_rows.filter("nth = 1").withColumns({"zone_low": F.least(a, b), "zone_high": F.greatest(a, b)})
    return out.withColumns({"zone_mid": (F.col("zone_low") + F.col("zone_high")) / 2, "zone_width_pct": 100 * ratio(F.col("zone_high") - F.col("zone_low"), (F.col("zone_low") + F.col("zone_high")) / 2)})


def targets(leg_rows: DataFrame, ratios: tuple[float, ...] = EXTENSIONS) -> DataFrame:
    """Extensions of the newest leg beyond its end, with reward over the risk of going back to its start."""
    out = leg_rows.filter("nth = 1").select("*", F.explode(F.array(*map(F.lit, ratios))).alias("ratio"))
    out = out.withColumn("target", F.col("start_price") + F.col("ratio") * (F.col("end_price") - F.col("start_price")))
    return out.withColumn("reward_risk", ratio(F.abs(F.col("target") - F.col("end_price")), F.abs(F.col("end_price") - F.col("start_price"))))


def clusters(levels: DataFrame, by: list[str], price: str = "level", tol_pct: float = 0.5) -> DataFrame:
    """Greedy 1-D clusters: from the lowest price not yet taken, all within tol_pct of it; one row each with size and mean.

    Levels of a group are few (legs times ratios); their anchors are found by one fold over the sorted prices.
    """
    prices = F.array_sort(F.collect_list(price))
    groups = levels.groupBy(*by).agg(prices.alias("p")).withColumn("a", anchors_of("p", tol_pct))
    rows = groups.select(*by, F.posexplode("a").alias("cluster", "anchor"), "p")
    members = F.filter("p", lambda x: (x >= F.col("anchor")) & (x <= F.col("anchor") * (1 + tol_pct / 100)))
    return rows.select(*by, "cluster", "anchor", F.size(members).alias("members"), (F.aggregate(members, F.lit(0.0), lambda s, x: s + x) / F.size(members)).alias("centre"))


def anchors_of(column: str, tol_pct: float) -> Column:
    return F.aggregate(column, F.array().cast("array<double>"), lambda acc, p: F.when((F.size(acc) == 0) | (p > F.element_at(acc, -1) * (1 + tol_pct / 100)), F.concat(acc, F.array(p))).otherwise(acc))


def overlap_score(df: DataFrame, levels: list[float], tol_pct: float = 0.05, price: str = "close") -> DataFrame:
    """1 at a level falling to 0 at tol_pct of price away, 0.1 more for each further level as near, at most 1."""
    near = F.transform(F.array(*map(F.lit, levels)), lambda v: 1 - F.abs(F.col(price) - v) / (F.col(price) * tol_pct))
    hits = F.filter(near, lambda x: x > 0)
    score = F.when(F.size(hits) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.array_max(hits) + 0.1 * (F.size(hits) - 1)))
    return df.withColumn("sr_score", score)


def zone_life(df: DataFrame, kind: str = "fvg", bottom: str = "fvg_bottom", top: str = "fvg_top", life: int = 50) -> DataFrame:
    """For each zone the first bar that touches it and the first that closes through it within ``life`` bars, and its end.

    Zones and bars meet on (symbol, tf) and blocks of ``life`` bars, so a zone is held against two blocks at most.
    """
    rows = df.withColumn("rn", F.row_number().over(series()))
    zones = rows.filter(F.col(kind) != 0).select(*KEY, F.col("ts").alias("born"), F.col("rn").alias("z_rn"), F.col(kind).alias("z_kind"), F.col(bottom).alias("z_bottom"), F.col(top).alias("z_top"))
    zones = zones.withColumn("block", F.explode(F.sequence(F.floor(F.col("z_rn") / life), F.floor((F.col("z_rn") + life) / life))))
    later = rows.select(*KEY, "rn", "high", "low", "close", F.floor(F.col("rn") / life).alias("block"))
    met = zones.join(later, [*KEY, "block"]).filter(f"rn > z_rn AND rn <= z_rn + {life}")
    touched = F.when(F.col("z_kind") == 1, F.col("low") <= F.col("z_top")).otherwise(F.col("high") >= F.col("z_bottom"))
    filled = F.when(F.col("z_kind") == 1, F.col("close") < F.col("z_bottom")).otherwise(F.col("close") > F.col("z_top"))
    out = met.groupBy(*KEY, "born", "z_kind", "z_bottom", "z_top").agg(F.min(F.when(touched, F.col("rn") - F.col("z_rn"))).alias("touch_age"), F.min(F.when(filled, F.col("rn") - F.col("z_rn"))).alias("fill_age"))
    state = F.when(F.col("fill_age").isNotNull(), "filled").when(F.col("touch_age").isNotNull(), "touched").otherwise("alive")
    return out.withColumn("state", state)


def soft_bias(df: DataFrame, column: str = "close", window: int = 8, least: int = 4, clip: float = 2.0, out: str = "bias") -> DataFrame:
    """Change over the window against its median and interquartile range, clipped and scaled to -1 .. 1."""
    step = df.withColumn("__c", F.col(column) - prev(column))
    step = step.withColumn("__s", F.when(F.count("__c").over(frame(window)) >= least, F.sum("__c").over(frame(window))))
    step = rolling_quantiles(step, "__s", window, {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75})
    robust = F.when(F.count("__s").over(frame(window)) >= least, ratio(F.col("__s") - F.col("__q2"), F.col("__q3") - F.col("__q1")))
    step = step.withColumn("__r", robust)
    # least and greatest skip nulls, so they are kept out
    return step.withColumn(out, F.when(F.col("__r").isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("__r"))) / clip)).drop("__c", "__s", "__r", "__q1", "__q2", "__q3")


def confluence(df: DataFrame, local: str = "bias", higher: str = "bias_high") -> DataFrame:
    """conflict: opposite signs; confluence: 1 less half the difference."""
    return df.withColumns({"conflict": F.coalesce((F.signum(local) * F.signum(higher) < 0).cast("int"), F.lit(0)), "confluence": 1 - F.abs(F.col(local) - F.col(higher)) / 2})


def select_legs(leg_rows: DataFrame, most: int = 3, least_move: float | None = None, least_share: float | None = None, most_age: int | None = None) -> DataFrame:
    """The newest ``most`` legs of a series that move by least_move, by least_share of their lower end, and have at most most_age legs after them."""
    move = F.abs(F.col("end_price") - F.col("start_price"))
    out = leg_rows
    if least_move is not None:
        out = out.filter(move >= least_move)
    if least_share is not None:
        out = out.filter(move >= least_share * F.greatest(F.least("start_price", "end_price"), F.lit(1e-9)))
    if most_age is not None:
        out = out.filter(F.col("nth") - 1 <= most_age)
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("nth"))).filter(F.col("nth") <= most)


def swing_points(leg_rows: DataFrame, known_end: bool = True) -> DataFrame:
    """a, b, c (and d) of every series: its last four swings, or without a known end the last three, d being null."""
    at = lambda n, side: F.max(F.when(F.col("nth") == n, F.col(side)))
    back = 1 if known_end else 0
    end = at(1, "end_price") if known_end else F.lit(None).cast("double")
    points = leg_rows.groupBy(*KEY).agg(at(2 + back, "start_price").alias("a"), at(1 + back, "start_price").alias("b"), at(1 + back, "end_price").alias("c"), end.alias("d"))
    return points.filter("a IS NOT NULL")


def equal_legs(points: DataFrame, tol: float = 0.05) -> DataFrame:
    """abcd_error: how far the length of CD is from that of AB, as a share of it; abcd: 1 where that is ``tol`` at most."""
    ab = F.abs(F.col("b") - F.col("a"))
    out = points.withColumns({"length_ab": ab, "cd_ratio": ratio(F.abs(F.col("d") - F.col("c")), ab)})
    out = out.withColumn("abcd_error", F.abs(F.col("cd_ratio") - 1))
    return out.withColumn("abcd", F.coalesce((F.col("abcd_error") <= tol).cast("int"), F.lit(0)))


def projections(points: DataFrame, ratios: tuple[float, ...] = (1.0, *EXTENSIONS), tol: float | None = None) -> DataFrame:
    """A row for each ratio: d_expected, that much of AB on from C in AB's direction, and its distance from d (null d: null) in lengths of AB.

    With ``tol`` only projections within it stay, and those without a d.
    """
    step = F.col("b") - F.col("a")
    out = points.select("*", F.explode(F.array(*map(F.lit, ratios))).alias("ratio"))
    out = out.withColumn("d_expected", F.col("c") + F.col("ratio") * step)
    out = out.withColumn("d_error", ratio(F.abs(F.col("d") - F.col("d_expected")), F.abs(step)))
    return out if tol is None else out.filter(F.col("d_error").isNull() | (F.col("d_error") <= tol))


def weighted_overlap(df: DataFrame, levels: list[float], weights: list[float] | None = None, tol_pct: float = 0.05, price: str = "close") -> DataFrame:
    """sr_weighted: the nearest level's weight by a logistic curve of its closeness, and the closeness of others within tol_pct (a share), by weight; 0 to 1."""
    pairs = list(zip(levels, weights or [1.0] * len(levels), strict=True))
    reach = F.abs(F.col(price)) * tol_pct
    near = F.array(*(F.struct(F.abs(F.col(price) - v).alias("far"), F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, (v, w) in enumerate(pairs)))
    out = df.withColumns({"__near": F.filter(near, lambda x: x["far"] <= reach), "__reach": reach})
    first = F.array_min("__near")
    closeness = lambda x: 1 - x["far"] / F.nullif(F.col("__reach"), F.lit(0.0))
    base = first["w"] / (1 + F.exp(-12 * (closeness(first) - 0.5)))
    others = F.aggregate("__near", F.lit(0.0), lambda s, x: s + F.when(x["k"] == first["k"], 0.0).otherwise(closeness(x) * x["w"]))
    return out.withColumn("sr_weighted", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.size("__near") > 0, base + others))), F.lit(0.0))).drop("__near", "__reach")


def trade_zones(zones: DataFrame, by: list[str], k: int = 5, stop: float = 1.5, target: float = 2.0, near_pct: float = 0.3) -> DataFrame:
    """The k zones (zone_low, zone_high, score, price, atr) of each group by score, then nearness, with stops, targets and reward over risk for both sides.

    Stops lie ``stop`` ATR outside the zone, targets ``target`` ATR. Where the ATR is null or not positive the group's mean zone width stands in.
    """
    width = F.col("zone_high") - F.col("zone_low")
    out = zones.withColumn("__a", F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.avg(width).over(Window.partitionBy(*by))))
    out = out.withColumns({"zone_mid": (F.col("zone_low") + F.col("zone_high")) / 2, "__band": F.col("price") * near_pct / 100})
    out = out.withColumns({"distance": F.abs(F.col("zone_mid") - F.col("price")), "near": ((F.col("price") >= F.col("zone_low") - F.col("__band")) & (F.col("price") <= F.col("zone_high") + F.col("__band"))).cast("int")})
    out = out.withColumns({"long_stop": F.col("zone_low") - stop * F.col("__a"), "long_target": F.col("zone_high") + target * F.col("__a"), "short_stop": F.col("zone_high") + stop * F.col("__a"), "short_target": F.col("zone_low") - target * F.col("__a")})
    out = out.withColumns({side + "_rr": ratio(sign * (F.col(side + "_target") - F.col("price")), sign * (F.col("price") - F.col(side + "_stop"))) for side, sign in (("long", 1), ("short", -1))})
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "distance", "zone_low", "zone_high"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).drop("__a", "__band")


def adaptive_tolerance(price: Column, width: Column, times: float, least: float, most: float) -> Column:
    """A share of price that follows a width such as ATR or ADR, within bounds; null without one of them."""
    raw = ratio(width, price) * times
    return F.when(raw.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), raw)))


def extreme_score(value: Column, low: float, high: float) -> Column:
    """1 at or beyond either bound, between them 1 in the middle falling to 0 towards the bounds (as an RSI's zones are scored)."""
    half = (high - low) / 2
    return F.when((value >= high) | (value <= low), 1.0).when(value.isNotNull(), 1 - F.abs(value - (low + half)) / half if half > 0 else 0.5)


def fractal_levels(df: DataFrame, k: int = 2, most: int = 30) -> DataFrame:
    """(key, level): prices of the last ``most`` fractal highs and lows each, every one known k bars after it; a level once."""
    n = 2 * k + 1
    whole = series().rowsBetween(-(n - 1), 0)
    full = F.count("*").over(whole) == n
    high, low = prev("high", k), prev("low", k)
    marked = df.withColumns({"__1": F.when(full & (high == F.max("high").over(whole)), high), "__-1": F.when(full & (low == F.min("low").over(whole)), low)})
    found = marked.select(*KEY, "ts", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"__{side}").alias("level")) for side in (1, -1)))).alias("f")).select(*KEY, "ts", "f.*").filter("level IS NOT NULL")
    newest = Window.partitionBy(*KEY, "side").orderBy(F.desc("ts"))
    return found.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= most).select(*KEY, "level").distinct()


def enhanced_scores(clusters: DataFrame, context: DataFrame, near: DataFrame, trend_weight: float = 10.0, level_weight: float = 10.0, tol_pct: float = 0.05) -> DataFrame:
    """Clusters (key, price, score) with trend_score, sr_score and the score they add up to.

    context: one row a key with slope and adr; the trend is tanh(slope / adr). near: (key, level); a level counts 1 at the cluster's
    price falling to 0 at tol_pct of it, 0.1 more for each further one as near, at most 1. A key has a bounded number of levels.
    """
    of = near.groupBy(*KEY).agg(F.array_sort(F.collect_list("level")).alias("__levels"))
    out = clusters.join(context.select(*KEY, "slope", "adr"), list(KEY), "left").join(of, list(KEY), "left")
    hits = F.filter(F.transform(F.coalesce("__levels", F.array().cast("array<double>")), lambda v: 1 - F.abs(F.col("price") - v) / (F.col("price") * tol_pct)), lambda x: x > 0)
    out = out.withColumns({
        "trend_score": F.coalesce(F.tanh(F.when(F.col("adr") > 0, F.col("slope") / F.col("adr")).otherwise(F.col("slope"))), F.lit(0.0)),
        "sr_score": F.when(F.size(hits) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.array_max(hits) + 0.1 * (F.size(hits) - 1))),
    })
    return out.withColumn("score", F.col("score") + trend_weight * F.col("trend_score") + level_weight * F.col("sr_score")).drop("slope", "adr", "__levels")


def nearest_cluster(df: DataFrame, clusters: DataFrame, price: str = "close", length: str = BLOCK) -> DataFrame:
    """nearest_price, nearest_score and nearest_signed (price less the cluster's) of the cluster nearest to each bar among those
    known by then (clusters: key, known_ts, price, score). Ties go to the lower price, then the lower score; a bar without a price has none.

    Bars go in blocks of time. A block needs the clusters that become known in it, and of those known before it the ones within its
    range of prices and the next on either side; it is swept in order of time over a sorted list, so its memory is bounded by
    these and time grows with bars and clusters, not with their product.
    """
    ship(df.sparkSession)
    names = df.columns
    own = df.withColumn("__block", block_of("ts", length))
    spans = own.groupBy(*OWN).agg(F.min("ts").alias("__a"), F.max("ts").alias("__b"), F.min(price).alias("__lo"), F.max(price).alias("__hi"))
    of = clusters.select(*KEY, "known_ts", F.col("price").alias("__p"), F.col("score").cast("double").alias("__s"))
    met = spans.join(of, list(KEY)).filter("known_ts <= __b AND __p IS NOT NULL")
    near = met.filter("known_ts > __a OR __p BETWEEN __lo AND __hi").select(*OWN, "known_ts", "__p", "__s")
    early = met.filter("known_ts <= __a")
    side = lambda test, way: early.filter(test).groupBy(*OWN).agg(F.max("__a").alias("known_ts"), F.min(F.struct((way * F.col("__p")).alias("k"), "__s")).alias("e")).select(*OWN, "known_ts", (way * F.col("e.k")).alias("__p"), F.col("e.__s").alias("__s"))
    wanted = near.unionByName(side("__p < __lo", F.lit(-1.0))).unionByName(side("__p > __hi", F.lit(1.0)))

    def sweep(bars: pa.Table, known: pa.Table) -> pa.Table:
        bars, known = bars.sort_by("ts"), known.sort_by("known_ts")
        prices: list[float] = []
        scores: dict[float, float] = {}
        waiting = list(zip(known.column("known_ts").to_pylist(), known.column("__p").to_pylist(), known.column("__s").to_pylist(), strict=True))
        at, found = 0, []
        for ts, x in zip(bars.column("ts").to_pylist(), bars.column(price).to_pylist(), strict=True):
            while at < len(waiting) and waiting[at][0] <= ts:
                _, p, s = waiting[at]
                if p not in scores:
                    insort(prices, p)
                    scores[p] = s
                elif s is None or (scores[p] is not None and s < scores[p]):
                    scores[p] = s
                at += 1
            i = 0 if x is None else bisect_left(prices, x)
            best = None if x is None else min(prices[max(0, i - 1) : i + 1], key=lambda p: (abs(x - p), p), default=None)  # noqa: B023
            found.append((best, scores.get(best)))
        near = [pa.array(c, pa.float64()) for c in (zip(*found, strict=True) if found else ((), ()))]
        return pa.table([*(bars.column(c) for c in names), *near], names=[*names, "nearest_price", "nearest_score"])

    schema = StructType([*df.schema.fields, StructField("nearest_price", DoubleType()), StructField("nearest_score", DoubleType())])
    wanted = wanted.select(*(F.col(c).alias(f"{c}_w") for c in OWN), "known_ts", "__p", "__s")
    out = own.groupBy(*OWN).cogroup(wanted.groupBy(*(f"{c}_w" for c in OWN))).applyInArrow(sweep, schema)
    return out.withColumn("nearest_signed", F.col(price) - F.col("nearest_price"))
