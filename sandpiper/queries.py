"""The engine's queries over the driver's tables, each with the SQL that gives the same rows.

Ticks are ``events``: symbol = event_type, price = value. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandpiper.functions.spec import SpecError, parse, replace_params
from sandpiper.functions.time_features import FEATURES, add_time_features
from sandpiper.operators import accounts as acc
from sandpiper.operators import blocks as blk
from sandpiper.operators import classic
from sandpiper.operators import confluence as conf
from sandpiper.operators import decisions as dec
from sandpiper.operators import joins as j
from sandpiper.operators import levels as lv
from sandpiper.operators import patterns as pat
from sandpiper.operators import recursive as rec
from sandpiper.operators import rolling as roll
from sandpiper.operators import structure as st
from sandpiper.operators import zigzags as zz
from sandpiper.operators import zones as zn
from sandpiper.plans import features as plans
from sandpiper.plans.registry import REGISTRY
from sandpiper.session import ship
from sandpiper.sources import candles as src
from sandpiper.sources import requests as req
from sandpiper.sources import store
from sandpiper.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str, tf: str = "H1") -> DataFrame:
    return src.candles(ticks(spark, sf_dir), tf)


def tidy(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *((F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c).cast("int").alias(c) if kinds[c] in ("tinyint", "boolean") else F.col(c) for c in values))


def on_bars(name: str, make: Callable[[DataFrame], DataFrame], values: list[str], sql: str | None = None, tf: str = "H1") -> None:
    """A query that adds columns to the H1 bars, keyed by symbol and ts."""
    QUERIES[name] = lambda spark, sf_dir: tidy(make(bars(spark, sf_dir, tf)), ["symbol", "ts"], values)
    if sql:
        ORACLE_SQL[name] = sql


def bars_cte(tf: str = "H1", name: str = "b") -> str:
    return f"""{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{src.MINUTES[tf]} minutes', ts) AS ts, arg_min(value, ts) AS open,
        max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


S = "PARTITION BY symbol ORDER BY ts"


def w(n: int) -> str:
    return f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def full(expr: str, n: int, c: str = "close") -> str:
    return f"CASE WHEN count({c}) OVER {w(n)} >= {n} THEN {expr} END"


# -- candles --------------------------------------------------------------------

CANDLE = ["open", "high", "low", "close", "volume"]
for _tf in ("M15", "H1", "H4", "D1"):
    on_bars(f"candles_{_tf.lower()}", lambda b: b, CANDLE, f"WITH {bars_cte(_tf)} SELECT symbol, ts, {', '.join(r6(c, c) for c in CANDLE[:4])}, volume FROM b", _tf)
QUERIES["resample_h1_to_d1"] = lambda s, d: tidy(src.resample(bars(s, d), "D1"), ["symbol", "ts"], CANDLE)
ORACLE_SQL["resample_h1_to_d1"] = f"WITH {bars_cte('D1')} SELECT symbol, ts, {', '.join(r6(c, c) for c in CANDLE[:4])}, CAST(volume AS BIGINT) AS volume FROM b"
QUERIES["candles_last_rows"] = lambda s, d: tidy(src.last_rows(bars(s, d), 50, 10), ["symbol", "ts"], ["close"])
ORACLE_SQL["candles_last_rows"] = f"WITH {bars_cte()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) SELECT symbol, ts, {r6('close', 'close')} FROM n WHERE k <= 50 AND k > 10"
QUERIES["candles_between"] = lambda s, d: tidy(src.between(bars(s, d), "2024-01-05 00:00:00", "2024-01-12 00:00:00"), ["symbol", "ts"], ["close"])
ORACLE_SQL["candles_between"] = f"WITH {bars_cte()} SELECT symbol, ts, {r6('close', 'close')} FROM b WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"
QUERIES["candles_upsert"] = lambda s, d: tidy(src.upsert(bars(s, d).filter("ts < '2024-01-15'"), bars(s, d).filter("ts >= '2024-01-10'").withColumn("close", F.col("close") + 1)), ["symbol", "ts"], ["close"])
ORACLE_SQL["candles_upsert"] = f"WITH {bars_cte()} SELECT symbol, ts, {r6('CASE WHEN ts >= TIMESTAMP ' + repr('2024-01-10') + ' THEN close + 1 ELSE close END', 'close')} FROM b"
QUERIES["candles_metadata"] = lambda s, d: src.metadata(bars(s, d)).drop("tf")
ORACLE_SQL["candles_metadata"] = f"WITH {bars_cte()} SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY symbol"


def _readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = spark.createDataFrame([("click", "H1", 100), ("view", "H1", 10**9), ("nobody", "H1", 1)], "symbol string, tf string, needed long")
    return src.readiness(bars(spark, sf_dir), needed).select("symbol", "needed", "rows", "status")


QUERIES["candles_readiness"] = _readiness
ORACLE_SQL["candles_readiness"] = f"""WITH {bars_cte()}, m AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), need(symbol, needed) AS (VALUES ('click', 100::BIGINT), ('view', 1000000000::BIGINT), ('nobody', 1::BIGINT))
    SELECT symbol, needed, coalesce(n, 0) AS rows, CASE WHEN n IS NULL THEN 'missing' WHEN n < needed THEN 'insufficient' ELSE 'ready' END AS status FROM need LEFT JOIN m USING (symbol)"""
QUERIES["feature_metadata"] = lambda s, d: src.feature_metadata(roll.sma(bars(s, d), period=50), ["close", "sma"]).withColumn("coverage_ratio", F.round("coverage_ratio", 6)).drop("tf")
ORACLE_SQL["feature_metadata"] = f"""WITH {bars_cte()}, f AS (SELECT *, {full(f'avg(close) OVER {w(50)}', 50)} AS sma FROM b)
    SELECT 'close' AS "column", min(ts) AS first_valid_ts, CAST(0 AS BIGINT) AS nan_count, 1.0::DOUBLE AS coverage_ratio FROM f
    UNION ALL SELECT 'sma', min(ts) FILTER (sma IS NOT NULL), count(*) FILTER (sma IS NULL), round(count(sma) / count(*)::DOUBLE, 6) FROM f"""

# -- window indicators ------------------------------------------------------------


def linear(rows: str, n: int) -> str:
    """The linear weighted mean of a list column, the newest weighing n."""
    return f"(list_sum([z[1] * (z[2] + {n} - len({rows})) FOR z IN list_zip({rows}, range(1, len({rows}) + 1))]) / list_sum([k + {n} - len({rows}) FOR k IN range(1, len({rows}) + 1)]))"


BB = ["bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent"]
BB_SQL = f"""WITH {bars_cte()}, m AS (SELECT *, {full(f'avg(close) OVER {w(8)}', 8)} AS mid, {full(f'stddev_pop(close) OVER {w(8)}', 8)} AS dev FROM b)
    SELECT symbol, ts, {r6('mid + 2 * dev', 'bb_upper')}, {r6('mid', 'bb_middle')}, {r6('mid - 2 * dev', 'bb_lower')}, {r6('4 * dev', 'bb_width')}, {r6('(close - (mid - 2 * dev)) / nullif((mid + 2 * dev) - (mid - 2 * dev), 0)', 'bb_percent')} FROM m"""
on_bars("bollinger", lambda b: roll.bollinger(b, period=8), BB, BB_SQL)
on_bars("sma_wma_hma", lambda b: roll.hma(roll.wma(roll.sma(b, period=20, min_periods=5), period=10), period=16), ["sma", "wma", "hma"], f"""
    WITH {bars_cte()}, a AS (SELECT *, list(close) OVER {w(10)} AS l10, list(close) OVER {w(16)} AS l16, list(close) OVER {w(8)} AS l8, count(*) OVER {w(20)} AS n20, avg(close) OVER {w(20)} AS m20 FROM b),
    d AS (SELECT *, 2 * {linear('l8', 8)} - {linear('l16', 16)} AS d FROM a), h AS (SELECT *, list(d) OVER {w(4)} AS l4, count(*) OVER {w(16)} AS n16 FROM d)
    SELECT symbol, ts, {r6('CASE WHEN n20 >= 5 THEN m20 END', 'sma')}, {r6('CASE WHEN len(l10) = 10 THEN ' + linear('l10', 10) + ' END', 'wma')}, {r6('CASE WHEN n16 >= 16 THEN ' + linear('l4', 4) + ' END', 'hma')} FROM h""")
TR = f"greatest(high - low, abs(high - lag(close) OVER ({S})), abs(low - lag(close) OVER ({S})))"
on_bars("true_range_atr_classic", lambda b: roll.atr_classic(roll.truerange(b), 14), ["true_range", "atr"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b) SELECT symbol, ts, {r6('tr', 'true_range')}, {r6(full(f'avg(tr) OVER {w(14)}', 14), 'atr')} FROM t""")
on_bars("roc_williams_stochastic", lambda b: roll.stochastic(roll.williamsr(roll.roc(b))), ["roc", "williamsr", "stoch_k", "stoch_d"], f"""
    WITH {bars_cte()}, x AS (SELECT *, max(high) OVER {w(14)} AS hh, min(low) OVER {w(14)} AS ll, count(*) OVER {w(14)} AS n, lag(close, 10) OVER ({S}) AS c10 FROM b),
    k AS (SELECT *, CASE WHEN n = 14 THEN CASE WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END END AS raw FROM x),
    s AS (SELECT *, CASE WHEN raw IS NOT NULL THEN avg(raw) OVER {w(3)} END AS sk FROM k)
    SELECT symbol, ts, {r6('(close - c10) / nullif(c10, 0) * 100', 'roc')}, {r6('CASE WHEN n = 14 AND hh - ll >= 1e-9 THEN -100 * (hh - close) / (hh - ll) END', 'williamsr')}, {r6('sk', 'stoch_k')},
    {r6(f'CASE WHEN sk IS NOT NULL THEN avg(sk) OVER {w(3)} END', 'stoch_d')} FROM s""")
on_bars("cci_mfi_aroon", lambda b: roll.aroon(roll.mfi(roll.cci(b, 20)), 25), ["cci", "mfi", "aroon_up", "aroon_down", "aroon_osc"], f"""
    WITH {bars_cte()}, x AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
    y AS (SELECT *, list(tp) OVER {w(20)} AS l, avg(tp) OVER {w(20)} AS m, tp * volume AS mf, tp - lag(tp) OVER ({S}) AS d, list_reverse(list(high) OVER {w(25)}) AS lh, list_reverse(list(low) OVER {w(25)}) AS ll FROM x),
    z AS (SELECT *, CASE WHEN d > 0 THEN mf WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN mf WHEN d IS NOT NULL THEN 0 END AS dn FROM y),
    s AS (SELECT *, {full(f'sum(up) OVER {w(14)}', 14, 'up')} AS su, {full(f'sum(dn) OVER {w(14)}', 14, 'up')} AS sd,
        CASE WHEN len(lh) = 25 THEN (25 - (list_position(lh, list_max(lh)) - 1)) / 25.0 * 100 END AS au, CASE WHEN len(ll) = 25 THEN (25 - (list_position(ll, list_min(ll)) - 1)) / 25.0 * 100 END AS ad FROM z)
    SELECT symbol, ts, {r6('CASE WHEN len(l) = 20 THEN (tp - m) / (0.015 * list_sum([abs(v - m) FOR v IN l]) / 20 + 1e-9) END', 'cci')}, {r6('CASE WHEN su + sd = 0 THEN 50 ELSE 100 * su / (su + sd) END', 'mfi')},
    {r6('au', 'aroon_up')}, {r6('ad', 'aroon_down')}, {r6('au - ad', 'aroon_osc')} FROM s""")
MF = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"
ALLW = f"({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
on_bars("volume_indicators", lambda b: roll.cmf(roll.adl(roll.vwap_rolling(roll.vwap_daily(roll.obv(b)), 30)), 20), ["obv", "vwap", "vwap_n", "adl", "cmf"], f"""
    WITH {bars_cte()}, x AS (SELECT *, coalesce(sign(close - lag(close) OVER ({S})), 0) * volume AS s, (high + low + close) / 3 * volume AS pv, {MF} AS mf FROM b)
    SELECT symbol, ts, {r6(f'sum(s) OVER {ALLW}', 'obv')},
    {r6('sum(pv) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) / sum(volume) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)', 'vwap')},
    {r6(full(f'sum(pv) OVER {w(30)} / sum(volume) OVER {w(30)}', 30), 'vwap_n')}, {r6(f'sum(mf) OVER {ALLW}', 'adl')}, {r6(full(f'sum(mf) OVER {w(20)} / sum(volume) OVER {w(20)}', 20), 'cmf')} FROM x""")
on_bars("donchian_ichimoku", lambda b: roll.ichimoku(roll.donchian(b, 20), 9, 26, 52), ["dc_upper", "dc_lower", "dc_mid", "dc_width", "dc_pos", "dc_break_up", "dc_break_down", "tenkan", "kijun", "span_a", "span_b"], f"""
    WITH {bars_cte()}, x AS (SELECT *, {full(f'max(high) OVER {w(20)}', 20)} AS u, {full(f'min(low) OVER {w(20)}', 20)} AS l,
        {', '.join(full(f'(max(high) OVER {w(n)} + min(low) OVER {w(n)}) / 2', n) + f' AS m{n}' for n in (9, 26, 52))} FROM b)
    SELECT symbol, ts, {r6('u', 'dc_upper')}, {r6('l', 'dc_lower')}, {r6('(u + l) / 2', 'dc_mid')}, {r6('u - l', 'dc_width')}, {r6('(close - l) / nullif(u - l, 0)', 'dc_pos')},
    CAST(coalesce(close > lag(u) OVER ({S}), false) AS INTEGER) AS dc_break_up, CAST(coalesce(close < lag(l) OVER ({S}), false) AS INTEGER) AS dc_break_down,
    {r6('m9', 'tenkan')}, {r6('m26', 'kijun')}, {r6(f'lag((m9 + m26) / 2, 26) OVER ({S})', 'span_a')}, {r6(f'lag(m52, 26) OVER ({S})', 'span_b')} FROM x""")
on_bars("zscore_slope_relative", lambda b: roll.relative(roll.ma_slope(roll.linreg_slope(roll.zscore(b), window=14))), ["zscore", "slope", "ma_slope", "open_rel", "high_rel", "low_rel", "close_rel", "volume_rel"], f"""
    WITH {bars_cte()}, x AS (SELECT *, row_number() OVER ({S}) AS rn, {full(f'avg(close) OVER {w(20)}', 20)} AS m, lag(close) OVER ({S}) AS pc FROM b)
    SELECT symbol, ts, {r6(full(f'(close - avg(close) OVER {w(20)}) / nullif(stddev_samp(close) OVER {w(20)}, 0)', 20), 'zscore')}, {r6(full(f'regr_slope(close, rn) OVER {w(14)}', 14), 'slope')},
    {r6(f'(m - lag(m, 3) OVER ({S})) / 3 / nullif(close, 0)', 'ma_slope')}, {', '.join(r6(f'{c} / nullif(pc, 0) - 1', c + '_rel') for c in CANDLE[:4])},
    {r6(f'volume / nullif(avg(volume) OVER ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)', 'volume_rel')} FROM x""")
on_bars("pivots", lambda b: roll.pivots_classic(roll.pivots(b, "close", 2)), ["pivot", "pp", "r1", "s1", "r2", "s2", "r3", "s3"], f"""
    WITH {bars_cte()}, x AS (SELECT *, list_reverse(list(close) OVER {w(5)}) AS v, lag(high) OVER ({S}) AS h, lag(low) OVER ({S}) AS l, lag(close) OVER ({S}) AS c FROM b), y AS (SELECT *, (h + l + c) / 3 AS p FROM x)
    SELECT symbol, ts, CAST(CASE WHEN len(v) = 5 AND list_position(v, list_max(v)) = 3 THEN 1 WHEN len(v) = 5 AND list_position(v, list_min(v)) = 3 THEN -1 ELSE 0 END AS INTEGER) AS pivot,
    {r6('p', 'pp')}, {r6('2 * p - l', 'r1')}, {r6('2 * p - h', 's1')}, {r6('p + (h - l)', 'r2')}, {r6('p - (h - l)', 's2')}, {r6('h + 2 * (p - l)', 'r3')}, {r6('l - 2 * (h - p)', 's3')} FROM y""")
on_bars("adr_round_levels", lambda b: roll.round_level_distance(roll.adr(b, 5), 10.0, 2.5, 20), ["day_open", "adr", "adr_dist", "adr_dist_pct", "round_level", "round_signed", "round_abs"], f"""
    WITH {bars_cte()}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) - min(low) AS r, arg_min(close, ts) AS o FROM b GROUP BY 1, 2),
    a AS (SELECT *, CASE WHEN count(r) OVER p >= 2 THEN avg(r) OVER p END AS adr FROM d WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    x AS (SELECT b.*, a.o, a.adr, 10.0 + greatest(-20, least(20, floor((close - 10.0) / 2.5 + 0.5))) * 2.5 AS lv FROM b JOIN a ON a.symbol = b.symbol AND a.day = CAST(b.ts AS DATE))
    SELECT symbol, ts, {r6('o', 'day_open')}, {r6('adr', 'adr')}, {r6('abs(close - o)', 'adr_dist')}, {r6('abs(close - o) / nullif(adr, 0) * 100', 'adr_dist_pct')}, {r6('lv', 'round_level')}, {r6('close - lv', 'round_signed')}, {r6('abs(close - lv)', 'round_abs')} FROM x""")

# -- recursive indicators -----------------------------------------------------------


def recurrence(name: str, source: str, a: str, b: str) -> str:
    """CTEs: y = a * y_before + b over the rows of ``source`` (symbol, rn); null b keeps the state and gives null."""
    return f"""{name}_t AS (SELECT symbol, rn, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {source}),
    {name} AS (SELECT symbol, rn, b AS y, b AS out FROM {name}_t WHERE rn = 1
        UNION ALL SELECT t.symbol, t.rn, CASE WHEN t.b IS NULL THEN p.y WHEN p.y IS NULL THEN t.b ELSE t.a * p.y + t.b END, CASE WHEN t.b IS NULL THEN NULL WHEN p.y IS NULL THEN t.b ELSE t.a * p.y + t.b END
        FROM {name} p JOIN {name}_t t ON t.symbol = p.symbol AND t.rn = p.rn + 1)"""


def ema_terms(c: str, n: int, first: int = 1) -> tuple[str, str]:
    return str(1 - 2 / (n + 1)), f"CASE WHEN rn = {first} THEN {c} WHEN rn > {first} THEN {2 / (n + 1)} * {c} END"


def seed_terms(c: str, n: int, alpha: float, skip: int = 0) -> tuple[str, str]:
    """c has values from row skip + 1 on; the mean of the first n is the seed."""
    return str(1 - alpha), f"CASE WHEN rn = {n + skip} THEN avg({c}) OVER {w(n)} WHEN rn > {n + skip} THEN {alpha} * {c} END"


NB = f"{bars_cte('H1', 'b0')}, b AS (SELECT *, row_number() OVER ({S}) AS rn, {TR} AS tr, close - lag(close) OVER ({S}) AS d, close - lag(close) OVER ({S}) AS diff FROM b0)"
on_bars("ema_dema_tema", lambda b: rec.means(b, {m: m for m in rec.MEANS}, period=6), ["ema", "dema", "tema"], f"""
    WITH RECURSIVE {NB}, {recurrence('e1', 'b', *ema_terms('close', 6))}, {recurrence('e2', '(SELECT symbol, rn, out AS x FROM e1)', *ema_terms('x', 6))}, {recurrence('e3', '(SELECT symbol, rn, out AS x FROM e2)', *ema_terms('x', 6))}
    SELECT symbol, ts, {r6('CASE WHEN rn >= 6 THEN e1.out END', 'ema')}, {r6('CASE WHEN rn >= 6 THEN 2 * e1.out - e2.out END', 'dema')}, {r6('CASE WHEN rn >= 6 THEN 3 * e1.out - 3 * e2.out + e3.out END', 'tema')}
    FROM b JOIN e1 USING (symbol, rn) JOIN e2 USING (symbol, rn) JOIN e3 USING (symbol, rn)""")
on_bars("macd", lambda b: rec.macd(b), ["macd", "macd_signal", "macd_hist"], f"""
    WITH RECURSIVE {NB}, {recurrence('f', 'b', *ema_terms('close', 12))}, {recurrence('s', 'b', *ema_terms('close', 26))}, m AS (SELECT symbol, rn, CASE WHEN rn >= 26 THEN f.out - s.out END AS x FROM f JOIN s USING (symbol, rn)),
    {recurrence('g', 'm', *ema_terms('x', 9, 26))}, z AS (SELECT symbol, rn, m.x, CASE WHEN rn >= 34 THEN g.out END AS g FROM m JOIN g USING (symbol, rn))
    SELECT symbol, ts, {r6('x', 'macd')}, {r6('g', 'macd_signal')}, {r6('x - g', 'macd_hist')} FROM b JOIN z USING (symbol, rn)""")
RSI = "CASE WHEN l.out = 0 THEN CASE WHEN g.out = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g.out / l.out) END"
for _m, _a in (("ema", 2 / 15), ("wilders", 1 / 14)):
    on_bars(f"rsi_{_m}", lambda b, m=_m: rec.rsi(b, method=m), ["rsi"], f"""
    WITH RECURSIVE {NB}, u AS (SELECT symbol, ts, rn, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM b), {recurrence('g', 'u', *seed_terms('up', 14, _a, 1))}, {recurrence('l', 'u', *seed_terms('dn', 14, _a, 1))}
    SELECT u.symbol, u.ts, {r6(RSI, 'rsi')} FROM u JOIN g USING (symbol, rn) JOIN l USING (symbol, rn)""")
for _m, _a in (("wilder", 1 / 14), ("ema", 2 / 15)):
    on_bars(f"atr_{_m}", lambda b, m=_m: rec.atr(b, 14, m), ["atr"], f"WITH RECURSIVE {NB}, {recurrence('a', 'b', *seed_terms('tr', 14, _a))} SELECT symbol, ts, {r6('a.out', 'atr')} FROM b JOIN a USING (symbol, rn)")
on_bars("keltner", lambda b: rec.keltner(b), ["kc_upper", "kc_middle", "kc_lower", "kc_width", "kc_percent"], f"""
    WITH RECURSIVE {NB}, {recurrence('m', 'b', *ema_terms('close', 20))}, {recurrence('a', 'b', *seed_terms('tr', 20, 1 / 20))}, z AS (SELECT symbol, ts, close, CASE WHEN rn >= 20 THEN m.out END AS m, a.out AS a FROM b JOIN m USING (symbol, rn) JOIN a USING (symbol, rn))
    SELECT symbol, ts, {r6('m + 2 * a', 'kc_upper')}, {r6('m', 'kc_middle')}, {r6('m - 2 * a', 'kc_lower')}, {r6('(m + 2 * a) - (m - 2 * a)', 'kc_width')}, {r6('(close - (m - 2 * a)) / nullif((m + 2 * a) - (m - 2 * a), 0)', 'kc_percent')} FROM z""")
SC = f"pow(CASE WHEN path < 1e-9 THEN 0 ELSE move / path END * ({2 / 3} - {2 / 31}) + {2 / 31}, 2)"
on_bars("kama", lambda b: rec.kama(b), ["kama"], f"""
    WITH RECURSIVE {NB}, c AS (SELECT *, abs(d) AS ad FROM b), e AS (SELECT *, sum(ad) OVER {w(9)} AS path, abs(close - lag(close, 9) OVER ({S})) AS move FROM c), s AS (SELECT *, {SC} AS sc FROM e),
    {recurrence('k', 's', '1 - sc', 'CASE WHEN rn = 10 THEN close WHEN rn > 10 THEN sc * close END')} SELECT symbol, ts, {r6('k.out', 'kama')} FROM b JOIN k USING (symbol, rn)""")
on_bars("heikin_ashi", rec.heikin_ashi, ["ha_open", "ha_high", "ha_low", "ha_close"], f"""
    WITH RECURSIVE {NB}, h AS (SELECT *, (open + high + low + close) / 4 AS hc FROM b), g AS (SELECT *, coalesce(lag(hc) OVER ({S}) / 2, (open + close) / 2) AS t FROM h), {recurrence('o', 'g', '0.5', 't')}
    SELECT symbol, ts, {r6('o.out', 'ha_open')}, {r6('greatest(high, o.out, hc)', 'ha_high')}, {r6('least(low, o.out, hc)', 'ha_low')}, {r6('hc', 'ha_close')} FROM g JOIN o USING (symbol, rn)""")
on_bars("adx", lambda b: rec.adx(b), ["plus_di", "minus_di", "adx"], f"""
    WITH RECURSIVE {NB}, q AS (SELECT *, high - lag(high) OVER ({S}) AS u, lag(low) OVER ({S}) - low AS v FROM b),
    x AS (SELECT symbol, ts, rn, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS m, tr FROM q),
    {recurrence('sp', 'x', *seed_terms('p', 14, 1 / 14, 1))}, {recurrence('sm', 'x', *seed_terms('m', 14, 1 / 14, 1))}, {recurrence('st', 'x', *seed_terms('tr', 14, 1 / 14, 1))},
    di AS (SELECT symbol, ts, rn, 100 * sp.out / nullif(st.out, 0) AS pd, 100 * sm.out / nullif(st.out, 0) AS md FROM x JOIN sp USING (symbol, rn) JOIN sm USING (symbol, rn) JOIN st USING (symbol, rn)),
    dx AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM di), {recurrence('a', 'dx', *seed_terms('dx', 14, 1 / 14, 14))}
    SELECT symbol, ts, {r6('pd', 'plus_di')}, {r6('md', 'minus_di')}, {r6('a.out', 'adx')} FROM dx JOIN a USING (symbol, rn)""")
on_bars("chaikin_volatility", rec.chaikin_volatility, ["chaikin_vol"], f"""
    WITH RECURSIVE {NB}, x AS (SELECT symbol, ts, rn, high - low AS r FROM b), {recurrence('e', 'x', *ema_terms('r', 10))}, y AS (SELECT symbol, ts, e.out AS v, lag(e.out, 10) OVER ({S}) AS v0 FROM x JOIN e USING (symbol, rn))
    SELECT symbol, ts, {r6('(v - v0) / nullif(v0, 0) * 100', 'chaikin_vol')} FROM y""")
on_bars("parabolic_sar", rec.parabolic_sar, ["psar"])
on_bars("supertrend", rec.supertrend, ["supertrend", "supertrend_dir"])
on_bars("supertrend_older", lambda b: rec.supertrend(b, release="current"), ["supertrend", "supertrend_dir"])
on_bars("market_structure", lambda b: pat.market_structure(rec.zigzag(b, 0.2)).fillna("", ["structure"]), ["zz", "zz_price", "structure", "bos", "choch", "regime"])
on_bars("divergence", lambda b: roll.divergence(rec.rsi(b)), ["div_bear", "div_bull"])

# -- calendar and patterns --------------------------------------------------------


def _time_sql() -> str:
    dow = "isodow(ts) - 1"
    month_end = "CAST(ts AS DATE) = last_day(ts)"
    ints = {
        "hour": "hour(ts)", "minute": "minute(ts)", "day_of_week": dow, "day_of_month": "day(ts)", "day_of_year": "dayofyear(ts)", "week_of_year": "week(ts)", "month": "month(ts)", "quarter": "quarter(ts)",
        "session_asia": "hour(ts) < 8", "session_london": "hour(ts) BETWEEN 8 AND 15", "session_newyork": "hour(ts) BETWEEN 13 AND 20", "is_weekend": f"{dow} >= 5", "is_month_start": "day(ts) = 1", "is_month_end": month_end,
        "is_quarter_start": "day(ts) = 1 AND month(ts) IN (1, 4, 7, 10)", "is_quarter_end": f"{month_end} AND month(ts) IN (3, 6, 9, 12)", "market_open_flag": "hour(ts) = 8", "market_close_flag": "hour(ts) = 21",
        "is_new_day": f"coalesce(CAST(lag(ts) OVER ({S}) AS DATE) <> CAST(ts AS DATE), true)",
    }
    waves = {"hour": ("hour(ts)", 24), "day_of_week": (dow, 7), "month": ("month(ts) - 1", 12)}
    cols = [f"CAST({v} AS INTEGER) AS {k}" for k, v in ints.items()] + [r6(f"{fn}(2 * pi() * ({v}) / {n})", f"{fn}_{k}") for fn in ("sin", "cos") for k, (v, n) in waves.items()]
    return f"WITH {bars_cte()} SELECT symbol, ts, {', '.join(cols)} FROM b"


on_bars("time_features", add_time_features, list(FEATURES), _time_sql())


def _pattern_sql() -> str:
    body, up, dn, rng = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)", "(high - low)"
    flags = {
        "engulf_bull": "c1 < o1 AND close > open AND close >= o1 AND open <= c1", "engulf_bear": "c1 > o1 AND close < open AND open >= c1 AND close <= o1",
        "doji": f"{body} / nullif({rng}, 0) <= 0.2", "pin_bull": f"{dn} >= 2 * {body} AND {up} <= {body}", "pin_bear": f"{up} >= 2 * {body} AND {dn} <= {body}",
        "hammer": f"{body} / nullif({rng}, 0) >= 0 AND {dn} >= 2 * {body} AND {up} <= 1.25 * {body}", "shooting_star": f"{body} / nullif({rng}, 0) >= 0 AND {up} >= 2 * {body} AND {dn} <= 1.25 * {body}",
        "harami_bull": "c1 < o1 AND close > open AND greatest(open, close) <= greatest(o1, c1) AND least(open, close) >= least(o1, c1)", "harami_bear": "c1 > o1 AND close < open AND greatest(open, close) <= greatest(o1, c1) AND least(open, close) >= least(o1, c1)",
        "inside_bar": "high < h1 AND low > l1", "outside_bar": "high > h1 AND low < l1",
        "marubozu_bull": f"{up} / nullif({rng}, 0) <= 0.1 AND {dn} / nullif({rng}, 0) <= 0.1 AND close > open", "marubozu_bear": f"{up} / nullif({rng}, 0) <= 0.1 AND {dn} / nullif({rng}, 0) <= 0.1 AND close < open",
        "tweezer_top": "abs(high - h1) / nullif(h1, 0) <= 0.001", "tweezer_bottom": "abs(low - l1) / nullif(l1, 0) <= 0.001",
        "three_soldiers": "close > open AND c1 > o1 AND c2 > o2 AND close > c1 AND c1 > c2", "three_crows": "close < open AND c1 < o1 AND c2 < o2 AND close < c1 AND c1 < c2",
        "morning_star": "c2 < o2 AND abs(c1 - o1) <= 0.3 * abs(c2 - o2) AND close > open AND close >= (o2 + c2) / 2", "evening_star": "c2 > o2 AND abs(c1 - o1) <= 0.3 * abs(c2 - o2) AND close < open AND close <= (o2 + c2) / 2",
        "piercing": "c1 < o1 AND close > open AND open < c1 AND close > (o1 + c1) / 2 AND close < o1", "dark_cloud": "c1 > o1 AND close < open AND open > c1 AND close < (o1 + c1) / 2 AND close > o1",
        "belt_bull": f"close > open AND (open - low) / nullif({rng}, 0) <= 0.1", "belt_bear": f"close < open AND (high - open) / nullif({rng}, 0) <= 0.1",
    }
    _pattern_sql.names = list(flags)
    back = ", ".join(f"lag({c}, {k}) OVER ({S}) AS {c[0]}{k}" for c in CANDLE[:4] for k in (1, 2))
    return f"WITH {bars_cte()}, x AS (SELECT *, {back} FROM b) SELECT symbol, ts, {', '.join(f'CAST(coalesce({v}, false) AS INTEGER) AS {k}' for k, v in flags.items())} FROM x"


_sql = _pattern_sql()
on_bars("candle_patterns", pat.all_patterns, _pattern_sql.names, _sql)

ATR14 = full(f"avg(tr) OVER {w(14)}", 14)
P5 = f"({S} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
on_bars("fair_value_gap", pat.fair_value_gap, ["fvg", "fvg_bottom", "fvg_top"], f"""
    WITH {bars_cte()}, x AS (SELECT *, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2 FROM b), k AS (SELECT *, CASE WHEN h2 < low THEN 1 WHEN l2 > high THEN -1 ELSE 0 END AS k FROM x),
    z AS (SELECT *, CASE k WHEN 1 THEN h2 WHEN -1 THEN high END AS bo, CASE k WHEN 1 THEN low WHEN -1 THEN l2 END AS t FROM k)
    SELECT symbol, ts, CAST(coalesce(lag(k) OVER ({S}), 0) AS INTEGER) AS fvg, {r6(f'lag(bo) OVER ({S})', 'fvg_bottom')}, {r6(f'lag(t) OVER ({S})', 'fvg_top')} FROM z""")
on_bars("liquidity_sweep", lambda b: pat.liquidity_sweep(roll.atr_classic(b)), ["sweep", "sweep_top", "sweep_bottom"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT *, {ATR14} AS a, max(high) OVER {P5} AS hi, min(low) OVER {P5} AS lo FROM t),
    k AS (SELECT *, CASE WHEN high > hi AND close < hi AND (high - greatest(open, close)) / nullif(a, 0) >= 0.5 THEN -1 WHEN low < lo AND close > lo AND (least(open, close) - low) / nullif(a, 0) >= 0.5 THEN 1 ELSE 0 END AS k FROM x)
    SELECT symbol, ts, CAST(coalesce(lag(k) OVER ({S}), 0) AS INTEGER) AS sweep, {r6('CASE k WHEN -1 THEN high WHEN 1 THEN lo END', 'sweep_top')}, {r6('CASE k WHEN -1 THEN hi WHEN 1 THEN low END', 'sweep_bottom')} FROM k""")
P3 = f"({S} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
on_bars("supply_demand", lambda b: pat.supply_demand(roll.atr_classic(b)), ["sd", "sd_bottom", "sd_top"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT *, {ATR14} AS a FROM t), q AS (SELECT *, CAST(coalesce((high - low) / nullif(a, 0) <= 0.6, false) AS INTEGER) AS q FROM x),
    s AS (SELECT *, coalesce((high - low) / nullif(a, 0) >= 1.2 AND abs(close - open) / nullif(high - low, 0) >= 0.55 AND sum(q) OVER {P3} = 3, false) AS st, min(low) OVER {P3} AS bo, max(high) OVER {P3} AS tp FROM q),
    k AS (SELECT *, CASE WHEN st AND close > open THEN 1 WHEN st AND close < open THEN -1 ELSE 0 END AS k FROM s)
    SELECT symbol, ts, CAST(k AS INTEGER) AS sd, {r6('CASE WHEN k <> 0 THEN bo END', 'sd_bottom')}, {r6('CASE WHEN k <> 0 THEN tp END', 'sd_top')} FROM k""")
LASTO = lambda test, v: f"last_value(CASE WHEN {test} THEN {v} END IGNORE NULLS) OVER {P5}"
on_bars("order_block", pat.order_block, ["ob", "ob_bottom", "ob_top"], f"""
    WITH {bars_cte()}, x AS (SELECT *, CASE WHEN close > max(high) OVER {P5} THEN 1 WHEN close < min(low) OVER {P5} THEN -1 ELSE 0 END AS k,
        {LASTO('close < open', 'low')} AS dl, {LASTO('close < open', 'high')} AS dh, {LASTO('close > open', 'low')} AS ul, {LASTO('close > open', 'high')} AS uh FROM b),
    z AS (SELECT *, CASE k WHEN 1 THEN dl WHEN -1 THEN ul END AS bo, CASE k WHEN 1 THEN dh WHEN -1 THEN uh END AS t FROM x)
    SELECT symbol, ts, CAST(CASE WHEN lag(t) OVER ({S}) IS NOT NULL THEN lag(k) OVER ({S}) ELSE 0 END AS INTEGER) AS ob, {r6(f'lag(bo) OVER ({S})', 'ob_bottom')}, {r6(f'lag(t) OVER ({S})', 'ob_top')} FROM z""")


def run_sql(c: str, source: str, out: str) -> str:
    """A CTE with the run length of a 0/1 column."""
    return f"{out}_g AS (SELECT *, sum(1 - {c}) OVER {ALLW} AS g_{out} FROM {source}), {out}_t AS (SELECT *, sum({c}) OVER (PARTITION BY symbol, g_{out} ORDER BY ts) AS {out} FROM {out}_g)"


on_bars("breakouts", lambda b: pat.breakouts(b, 20, 10, 2), ["range_high", "range_low", "break_up", "break_down"], f"""
    WITH {bars_cte()}, x AS (SELECT *, CASE WHEN count(high) OVER {w(20)} >= 10 THEN max(high) OVER {w(20)} END AS hi, CASE WHEN count(low) OVER {w(20)} >= 10 THEN min(low) OVER {w(20)} END AS lo FROM b),
    f AS (SELECT *, CAST(coalesce(close > lag(hi) OVER ({S}), false) AS INTEGER) AS a, CAST(coalesce(close < lag(lo) OVER ({S}), false) AS INTEGER) AS z FROM x), {run_sql('a', 'f', 'ra')}, {run_sql('z', 'ra_t', 'rz')}
    SELECT symbol, ts, {r6('hi', 'range_high')}, {r6('lo', 'range_low')}, coalesce(lag(CAST(ra >= 2 AS INTEGER)) OVER ({S}), 0) AS break_up, coalesce(lag(CAST(rz >= 2 AS INTEGER)) OVER ({S}), 0) AS break_down FROM rz_t""")
on_bars("microchannels", pat.microchannels, ["mc", "mc_length"], f"""
    WITH {bars_cte()}, f AS (SELECT *, CAST(coalesce((high - close) / nullif(high - low, 0) <= 0.2, false) OR coalesce(low > lag(low) OVER ({S}), false) AS INTEGER) AS u,
        CAST(coalesce((close - low) / nullif(high - low, 0) <= 0.2, false) OR coalesce(high < lag(high) OVER ({S}), false) AS INTEGER) AS d FROM b), {run_sql('u', 'f', 'ru')}, {run_sql('d', 'ru_t', 'rd')},
    k AS (SELECT *, CASE WHEN ru >= 3 AND ru >= rd THEN 1 WHEN rd >= 3 THEN -1 ELSE 0 END AS k FROM rd_t)
    SELECT symbol, ts, CAST(k AS INTEGER) AS mc, CAST(CASE k WHEN 1 THEN ru WHEN -1 THEN rd ELSE 0 END AS BIGINT) AS mc_length FROM k""")
on_bars("regime", lambda b: pat.regime(roll.atr_classic(b)).fillna("", ["regime_label"]), ["width_atr", "spike_atr", "slope_atr", "regime_label"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr, row_number() OVER ({S}) AS rn FROM b),
    x AS (SELECT *, {ATR14} AS a, {full(f'regr_slope(close, rn) OVER {w(12)}', 12)} AS sl, quantile_cont(close, 0.75) OVER {w(20)} - quantile_cont(close, 0.25) OVER {w(20)} AS iq FROM t),
    y AS (SELECT *, iq / nullif(a, 0) AS wa, (high - low) / nullif(a, 0) AS sp, sl / nullif(a, 0) AS sa FROM x)
    SELECT symbol, ts, {r6('wa', 'width_atr')}, {r6('sp', 'spike_atr')}, {r6('sa', 'slope_atr')}, CASE WHEN sp >= 2.5 THEN 'spike' WHEN abs(sa) >= 0.1 THEN 'trend' WHEN wa IS NOT NULL THEN 'range' ELSE '' END AS regime_label FROM y""")

# -- joins in time ----------------------------------------------------------------

H4 = f"{bars_cte('H4', 'h4')}"


def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = {tf: bars(spark, sf_dir, tf).withColumn("volume", F.col("volume").cast("double")) for tf in ("H4", "D1")}
    return tidy(j.align(bars(spark, sf_dir), "H1", others, ["close", "volume"]), ["symbol", "ts"], ["close", "H4_close", "H4_volume", "D1_close", "D1_volume"])


QUERIES["asof_align"] = _align
ORACLE_SQL["asof_align"] = f"""WITH {bars_cte()}, {H4}, {bars_cte('D1', 'd1')}, x AS (SELECT *, ts + INTERVAL 60 MINUTE AS at FROM b),
    a AS (SELECT *, ts + INTERVAL 240 MINUTE AS at FROM h4), d AS (SELECT *, ts + INTERVAL 1440 MINUTE AS at FROM d1)
    SELECT x.symbol, x.ts, {r6('x.close', 'close')}, {r6('a.close', '"H4_close"')}, {r6('a.volume', '"H4_volume"')}, {r6('d.close', '"D1_close"')}, {r6('d.volume', '"D1_volume"')}
    FROM x ASOF LEFT JOIN a ON x.symbol = a.symbol AND x.at >= a.at ASOF LEFT JOIN d ON x.symbol = d.symbol AND x.at >= d.at"""
QUERIES["candle_lags"] = lambda s, d: tidy(j.candle_lags(bars(s, d).select("symbol", "ts"), bars(s, d, "H4").withColumn("volume", F.col("volume").cast("double")), "H4", ["close", "volume"], 3), ["symbol", "ts"], [f"H4_lag{k}_{c}" for k in range(3) for c in ("close", "volume")])
ORACLE_SQL["candle_lags"] = f"""WITH {bars_cte()}, {H4}, a AS (SELECT symbol, ts + INTERVAL 240 MINUTE AS at, {', '.join(f'lag({c}, {k}) OVER ({S}) AS {c}{k}' for k in range(3) for c in ('close', 'volume'))} FROM h4)
    SELECT b.symbol, b.ts, {', '.join(r6(f'close{k}', f'"H4_lag{k}_close"') + ', ' + r6(f'volume{k}', f'"H4_lag{k}_volume"') for k in range(3))} FROM b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a.at"""
QUERIES["exact_quotes"] = lambda s, d: tidy(j.exact_quotes(bars(s, d, "H4").select("symbol", "ts"), bars(s, d).withColumn("spread", F.col("volume") % 7), 0.01, False), ["symbol", "ts"], ["bid", "ask"])
ORACLE_SQL["exact_quotes"] = f"WITH {bars_cte()}, {H4} SELECT h4.symbol, h4.ts, {r6('b.close', 'bid')}, {r6('b.close + b.volume % 7 * 0.01', 'ask')} FROM h4 LEFT JOIN b ON b.symbol = h4.symbol AND b.ts = h4.ts"
QUERIES["positional_align"] = lambda s, d: tidy(j.positional(bars(s, d), bars(s, d, "H4"), "close", "high_close"), ["symbol", "ts"], ["close", "high_close"])
ORACLE_SQL["positional_align"] = f"""WITH {bars_cte()}, {H4}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), m AS (SELECT symbol, count(*) AS m FROM h4 GROUP BY 1),
    x AS (SELECT b.*, row_number() OVER ({S.replace('symbol', 'b.symbol')}) - 1 AS i FROM b), y AS (SELECT symbol, close, row_number() OVER ({S}) - 1 AS k FROM h4)
    SELECT x.symbol, x.ts, {r6('x.close', 'close')}, {r6('y.close', 'high_close')} FROM x JOIN n USING (symbol) JOIN m USING (symbol) JOIN y ON y.symbol = x.symbol AND y.k = least(x.i // greatest(1, n // m), m - 1)"""
QUERIES["uneven_timeline"] = lambda s, d: j.same_timeline(bars(s, d, "H1"))
ORACLE_SQL["uneven_timeline"] = f"WITH {bars_cte()} SELECT ts, count(DISTINCT symbol) AS n FROM b GROUP BY ts HAVING count(DISTINCT symbol) < (SELECT count(DISTINCT symbol) FROM b)"
NEWS = [("2024-01-03", "09:30", " usd", "High", "Jobs", 1), ("2024-01-03", "10:00", "EUR", "orange", "Rates", 2), ("2024-01-10", "All Day", "USD", "medium", "Holiday talks", 3), ("2024-01-10", "All Day", "USD", "low", "Holiday talks", 4), ("2024-01-11", "Tentative", "GBP", "??", "Speech", 5), ("2024-01-12", "13:05", "usd", "red", "Prices", 6), ("never", "13:05", "usd", "red", "Lost", 7)]
CURRENCIES = [("click", "USD"), ("click", "EUR"), ("view", "EUR"), ("error", "GBP"), ("purchase", "USD")]


def _news(spark: SparkSession) -> DataFrame:
    return j.normalise_news(spark.createDataFrame(NEWS, "date string, time string, currency string, impact string, event string, seq int"))


RAW_NEWS = {"clock": "CASE event_id % 5 WHEN 0 THEN 'All Day' WHEN 1 THEN ' ' ELSE {hhmm} END", "impact": "CASE event_id % 6 WHEN 0 THEN ' High' WHEN 1 THEN 'ORANGE' WHEN 2 THEN '3' WHEN 3 THEN 'med' ELSE '??' END"}
QUERIES["news_events"] = lambda s, d: j.normalise_news(s.read.parquet(f"{d}/events.parquet").selectExpr("CASE WHEN event_id % 11 = 0 THEN 'never' ELSE date_format(ts, 'yyyy-MM-dd') END date", RAW_NEWS["clock"].format(hhmm="date_format(ts, 'HH:mm')") + " time", "concat(' ', substr(event_type, 1, 3)) currency", RAW_NEWS["impact"] + " impact", "event_type event", "event_id seq"))
NEWS_SQL = """(VALUES (TIMESTAMP '2024-01-03 09:30:00', 'USD', 'high', 'Jobs', 30, 15), (TIMESTAMP '2024-01-03 10:00:00', 'EUR', 'medium', 'Rates', 15, 15), (TIMESTAMP '2024-01-10 00:00:00', 'USD', 'medium', 'Holiday talks', 15, 15),
    (TIMESTAMP '2024-01-11 00:00:00', 'GBP', 'low', 'Speech', 0, 0), (TIMESTAMP '2024-01-12 13:05:00', 'USD', 'high', 'Prices', 30, 15)) v(time_utc, currency, impact, title, before_min, after_min)"""
ORACLE_SQL["news_events"] = f"""WITH x AS (SELECT CASE WHEN event_id % 5 < 2 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END AS t, upper(substr(event_type, 1, 3)) AS c, lower(trim({RAW_NEWS['impact']})) AS w, event_type AS title, event_id FROM events WHERE event_id % 11 <> 0 AND ts IS NOT NULL),
    y AS (SELECT *, CASE WHEN w IN ('high', '3') THEN 'high' WHEN w IN ('orange', 'med') THEN 'medium' ELSE 'low' END AS impact, row_number() OVER (PARTITION BY t, c, title ORDER BY event_id) AS n FROM x)
    SELECT CAST(t AS TIMESTAMP) AS time_utc, c AS currency, impact, title, CASE impact WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 0 END AS before_min, CASE impact WHEN 'low' THEN 0 ELSE 15 END AS after_min FROM y WHERE n = 1"""


def _news_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(CURRENCIES, "symbol string, currency string")
    return j.news_gate(bars(spark, sf_dir, "M15").select("symbol", "ts"), _news(spark), pairs)


QUERIES["news_gate"] = _news_gate
ORACLE_SQL["news_gate"] = f"""WITH {bars_cte('M15')}, n AS (SELECT * FROM {NEWS_SQL}), c(symbol, currency) AS (VALUES {', '.join(map(str, CURRENCIES))}),
    h AS (SELECT b.symbol, b.ts, max(CASE WHEN impact = 'high' THEN 1 ELSE 0 END) AS f, max(CASE WHEN impact = 'medium' THEN 1 ELSE 0 END) AS r, string_agg(DISTINCT title, ';' ORDER BY title) AS titles
        FROM b JOIN c USING (symbol) JOIN n USING (currency) WHERE b.ts BETWEEN time_utc - to_minutes(before_min) AND time_utc + to_minutes(after_min) GROUP BY 1, 2)
    SELECT b.symbol, b.ts, titles, coalesce(f, 0) AS freeze, CASE WHEN coalesce(f, 0) = 1 THEN 0 ELSE coalesce(r, 0) END AS reduce FROM b LEFT JOIN h ON h.symbol = b.symbol AND h.ts = b.ts"""

# -- specifications and observations ------------------------------------------------

SPECS = ["sma(close, 5)@H1", "bollinger_bands(close, 8, 2)@H1", "roc(n=3)@H4", "sma(period=5)", "williams_r(5)@H4"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = plans.features({"H1": bars(spark, sf_dir), "H4": bars(spark, sf_dir, "H4")}, SPECS, "H1")
    obs = plans.observations(tables, "H1", shift=1, deny=["bb_width*", "bb_percent*"], lags={"H4": (["close"], 2)})
    return tidy(obs, ["symbol", "ts"], [c for c in obs.columns if c not in ("symbol", "tf", "ts")])


QUERIES["observations"] = _observations
ORACLE_SQL["observations"] = f"""WITH {bars_cte()}, {H4},
    f AS (SELECT symbol, ts, {full(f'avg(close) OVER {w(5)}', 5)} AS sma, {full(f'avg(close) OVER {w(8)}', 8)} AS mid, {full(f'stddev_pop(close) OVER {w(8)}', 8)} AS dev FROM b),
    g AS (SELECT symbol, ts + INTERVAL 240 MINUTE AS at, (close - lag(close, 3) OVER ({S})) / nullif(lag(close, 3) OVER ({S}), 0) * 100 AS roc,
        CASE WHEN count(*) OVER {w(5)} = 5 AND max(high) OVER {w(5)} - min(low) OVER {w(5)} >= 1e-9 THEN -100 * (max(high) OVER {w(5)} - close) / (max(high) OVER {w(5)} - min(low) OVER {w(5)}) END AS wr, close AS c0, lag(close) OVER ({S}) AS c1 FROM h4),
    a AS (SELECT f.*, g.roc, g.wr FROM f ASOF LEFT JOIN g ON f.symbol = g.symbol AND f.ts + INTERVAL 60 MINUTE >= g.at),
    s AS (SELECT symbol, ts, {', '.join(f'lag({c}) OVER ({S}) AS {c}' for c in ('sma', 'mid', 'dev', 'roc', 'wr'))} FROM a),
    k AS (SELECT *, bool_or(sma IS NOT NULL AND mid IS NOT NULL AND roc IS NOT NULL AND wr IS NOT NULL) OVER {ALLW} AS ok FROM s)
    SELECT k.symbol, k.ts, {r6('sma', 'sma_close_5__1_h1')}, {r6('mid + 2 * dev', 'bb_upper_close_8_2_0__1_h1')}, {r6('mid', 'bb_middle_close_8_2_0__1_h1')}, {r6('mid - 2 * dev', 'bb_lower_close_8_2_0__1_h1')},
    {r6('k.roc', 'roc_close_3_h4')}, {r6('k.wr', 'williamsr_5__1_h4')}, {r6('g.c0', '"H4_lag0_close"')}, {r6('g.c1', '"H4_lag1_close"')} FROM k ASOF LEFT JOIN g ON k.symbol = g.symbol AND k.ts >= g.at WHERE ok"""

# -- fills, risk and reports ----------------------------------------------------------


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills: two sides, lots of a hundredth of the quantity, quotes around the unit price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return lines.select(
        F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").alias("fill_no"), F.col("l_suppkey").alias("account"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"), (F.col("l_quantity").cast("double") / 100).alias("lots"), (price - 0.5).alias("bid"), (price + 0.5).alias("ask"),
        (F.col("l_tax").cast("double")).alias("slippage"), F.when(F.col("l_linestatus") == "O", "per_lot").when(F.col("l_returnflag") == "A", "percent_notional").otherwise("fixed").alias("commission_kind"),
        F.lit(0.7).alias("commission_rate"), F.lit(0.05).alias("commission_minimum"),
    )


FILLS_SQL = """l AS (SELECT l_orderkey AS execution_id, l_linenumber AS fill_no, l_suppkey AS account, CAST(l_shipdate AS TIMESTAMP) AS ts, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side,
        CAST(l_quantity AS DOUBLE) / 100 AS lots, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS p, CAST(l_tax AS DOUBLE) AS slippage,
        CASE WHEN l_linestatus = 'O' THEN 'per_lot' WHEN l_returnflag = 'A' THEN 'percent_notional' ELSE 'fixed' END AS kind FROM lineitem),
    f AS (SELECT *, p + side * 0.5 AS market, p + side * 0.5 + side * slippage AS fill_price, 0.5 * lots AS spread_cost, slippage * lots AS slippage_cost FROM l),
    k AS (SELECT *, greatest(CASE kind WHEN 'fixed' THEN 0.7 WHEN 'per_lot' THEN 0.7 * lots ELSE 0.7 / 100 * fill_price * lots END, 0.05) AS commission FROM f),
    c AS (SELECT *, spread_cost + slippage_cost + commission AS total_cost FROM k)"""
COST = ["fill_price", "spread_cost", "slippage_cost", "commission", "total_cost"]
QUERIES["fill_costs"] = lambda s, d: tidy(acc.fill_costs(_fills(s, d)), ["execution_id", "fill_no"], COST, 10)
ORACLE_SQL["fill_costs"] = f"WITH {FILLS_SQL} SELECT execution_id, fill_no, {', '.join(r6(c, c, 10) for c in COST)} FROM c"


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = acc.fill_costs(_fills(spark, sf_dir))
    actual = costs.filter("execution_id % 5 <> 0").withColumn("total_cost", F.col("total_cost") * F.when(F.col("fill_no") == 1, 1.1).otherwise(1.0))
    return tidy(acc.reconcile(costs.filter("execution_id % 7 <> 0"), actual), ["execution_id"], ["expected", "actual", "variance", "status"], 10)


QUERIES["reconcile_costs"] = _reconcile
ORACLE_SQL["reconcile_costs"] = f"""WITH {FILLS_SQL}, e AS (SELECT execution_id, sum(total_cost) AS e FROM c WHERE execution_id % 7 <> 0 GROUP BY 1), a AS (SELECT execution_id, sum(total_cost * CASE WHEN fill_no = 1 THEN 1.1 ELSE 1.0 END) AS a FROM c WHERE execution_id % 5 <> 0 GROUP BY 1)
    SELECT execution_id, {r6('coalesce(e, 0)', 'expected', 10)}, {r6('coalesce(a, 0)', 'actual', 10)}, {r6('coalesce(a, 0) - coalesce(e, 0)', 'variance', 10)}, CASE WHEN e IS NULL THEN 'unexpected' WHEN a IS NULL THEN 'missing' ELSE 'matched' END AS status FROM e FULL JOIN a USING (execution_id)"""
ORDER = ["ts", "execution_id", "fill_no"]
#: Fills that tie in ORDER go by all that the results hang on: each window takes them alike, however the table is stored.
TOTAL_ORDER = [*ORDER, "side", "lots", "fill_price", "commission"]


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = acc.positions(acc.fill_costs(_fills(spark, sf_dir)), ("account",), TOTAL_ORDER).withColumn("equity", F.col("equity") + 1_000_000)
    return tidy(acc.drawdown(rows, ("account",), TOTAL_ORDER), ["account", "execution_id", "fill_no"], ["position", "cash", "action", "equity", "peak", "total_drawdown", "daily_drawdown"])


QUERIES["positions_drawdown"] = _positions
A = "PARTITION BY account ORDER BY ts, execution_id, fill_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ORACLE_SQL["positions_drawdown"] = f"""WITH {FILLS_SQL}, p AS (SELECT *, sum(side * lots) OVER ({A}) AS position, sum(-side * lots * fill_price - commission) OVER ({A}) AS cash FROM c),
    q AS (SELECT *, position - side * lots AS old, cash + position * fill_price + 1000000 AS equity FROM p), r AS (SELECT *, max(equity) OVER ({A}) AS peak, first_value(equity) OVER ({A.replace('account', 'account, CAST(ts AS DATE)', 1)}) AS d0 FROM q)
    SELECT account, execution_id, fill_no, {r6('position', 'position')}, {r6('cash', 'cash')},
    CASE WHEN old = position THEN 'HOLD' WHEN old = 0 THEN 'OPEN' WHEN position = 0 THEN 'CLOSE' WHEN sign(old) <> sign(position) THEN 'REVERSE' WHEN abs(position) > abs(old) THEN 'INCREASE' ELSE 'REDUCE' END AS action,
    {r6('equity', 'equity')}, {r6('peak', 'peak')}, {r6('greatest(0, (peak - equity) / nullif(peak, 0))', 'total_drawdown')}, {r6('greatest(0, (d0 - equity) / nullif(d0, 0))', 'daily_drawdown')} FROM r"""
SIZES = ["lots", "loss_per_lot", "stop_lots", "final_lots", "margin"]
QUERIES["position_sizing"] = lambda s, d: tidy(acc.sizing(roll.atr_classic(bars(s, d)).selectExpr("symbol", "ts", "close price", "close - 2 * atr stop_price", "10000D equity", "0.25D exposure", "0.01D risk")), ["symbol", "ts"], SIZES)
ORACLE_SQL["position_sizing"] = f"""WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT symbol, ts, close AS p, close - 2 * ({ATR14}) AS st FROM t), y AS (SELECT *, 2500 / nullif(p, 0) AS l, abs(p - st) AS d FROM x), z AS (SELECT *, 100 / nullif(d, 0) AS sl FROM y)
    SELECT symbol, ts, {r6('l', 'lots')}, {r6('d', 'loss_per_lot')}, {r6('sl', 'stop_lots')}, {r6('least(l, sl)', 'final_lots')}, {r6('least(l, sl) * p / 30', 'margin')} FROM z"""
QUERIES["risk_limits"] = lambda s, d: tidy(acc.risk_limits(roll.roc(bars(s, d), period=3).filter("roc IS NOT NULL").selectExpr("symbol", "ts", "roc / 100 exposure"), "ts"), ["symbol", "ts"], ["exposure", "capped", "final", "status"])
ORACLE_SQL["risk_limits"] = f"""WITH {bars_cte()}, x AS (SELECT symbol, ts, (close - lag(close, 3) OVER ({S})) / nullif(lag(close, 3) OVER ({S}), 0) * 100 / 100 AS e FROM b), y AS (SELECT *, sign(e) * least(abs(e), 0.3) AS c FROM x WHERE e IS NOT NULL), z AS (SELECT *, sum(abs(c)) OVER (PARTITION BY ts) AS t FROM y),
    f AS (SELECT *, CASE WHEN t > 1 THEN c / t ELSE c END AS f FROM z) SELECT symbol, ts, {r6('e', 'exposure')}, {r6('c', 'capped')}, {r6('f', 'final')}, CASE WHEN f = e THEN 'approved' ELSE 'modified' END AS status FROM f"""
QUERIES["backtest_report"] = lambda s, d: tidy(acc.report(bars(s, d).withColumn("pnl", F.col("close") - F.col("open")), ("symbol",), ["ts"]), ["symbol"], ["total", "mean", "trades", "win_rate", "profit_factor", "sharpe", "max_drawdown", "trades_per_day"])
ORACLE_SQL["backtest_report"] = f"""WITH {bars_cte()}, t AS (SELECT *, close - open AS pnl, sum(close - open) OVER {ALLW} AS eq FROM b), p AS (SELECT *, max(eq) OVER {ALLW} AS peak FROM t)
    SELECT symbol, {r6('sum(pnl)', 'total')}, {r6('avg(pnl)', 'mean')}, count(*) AS trades, {r6('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {r6('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 0)', 'profit_factor')},
    {r6('avg(pnl) / (stddev_samp(pnl) + 1e-12) * sqrt(count(*))', 'sharpe')}, {r6('max(peak - eq) / greatest(1.0, abs(max(peak)))', 'max_drawdown')}, {r6('count(*)::DOUBLE / count(DISTINCT CAST(ts AS DATE))', 'trades_per_day')} FROM p GROUP BY symbol"""
QUERIES["account_guard"] = lambda s, d: s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "CAST(c_acctbal AS DOUBLE) equity", "CAST(c_nationkey AS DOUBLE) * 100 used").withColumn("level", roll.ratio(F.col("equity"), F.col("used"))).select("c_custkey", F.coalesce(acc.guard(F.col("equity"), F.col("equity") - F.col("used"), F.col("used"), F.col("level")), F.lit("OK")).alias("verdict"))
ORACLE_SQL["account_guard"] = "WITH x AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS e, CAST(c_nationkey AS DOUBLE) * 100 AS u FROM customer) SELECT c_custkey, CASE WHEN e <= 0 THEN 'EQUITY_NOT_POSITIVE' WHEN e - u < 0 THEN 'NO_FREE_MARGIN' WHEN u < 0 THEN 'BAD_USED_MARGIN' WHEN u / nullif(e, 0) > 0.5 THEN 'MARGIN_UTILISATION' WHEN e / nullif(u, 0) < 1.5 THEN 'MARGIN_LEVEL' ELSE 'OK' END AS verdict FROM x"
QUERIES["normalise_lots"] = lambda s, d: tidy(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", acc.normalise_lots(F.col("l_quantity").cast("double") / 7, 0.5, 0.25, 5.0).alias("lots")), ["l_orderkey", "l_linenumber"], ["lots"])
ORACLE_SQL["normalise_lots"] = f"SELECT l_orderkey, l_linenumber, {r6('round_even(greatest(0.5, least(5.0, CAST(l_quantity AS DOUBLE) / 7)) / 0.25, 0) * 0.25', 'lots')} FROM lineitem"
QUERIES["top_zones"] = lambda s, d: tidy(acc.top_zones(bars(s, d).selectExpr("symbol", "low price", "high - low score", "volume members"), "symbol", 10, 2), ["symbol", "rank"], ["price", "score", "members"])
ORACLE_SQL["top_zones"] = f"WITH {bars_cte()}, z AS (SELECT symbol, low, high - low AS s, volume, row_number() OVER (PARTITION BY symbol ORDER BY high - low DESC, low) AS k FROM b WHERE volume >= 2) SELECT symbol, CAST(k AS INTEGER) AS rank, {r6('low', 'price')}, {r6('s', 'score')}, volume AS members FROM z WHERE k <= 10"

# -- older definitions, levels and more of accounts -----------------------------------

on_bars("classic_recursive", lambda b: classic.macd(classic.rsi(classic.ema(b, period=10))), ["classic_ema", "classic_rsi", "classic_macd", "classic_macd_signal", "classic_macd_hist"], f"""
    WITH RECURSIVE {NB}, u AS (SELECT symbol, ts, rn, close, greatest(coalesce(d, 0), 0) AS up, greatest(-coalesce(d, 0), 0) AS dn FROM b), {recurrence('e', 'b', *seed_terms('close', 10, 2 / 11))},
    {recurrence('g', 'u', *ema_terms('up', 14))}, {recurrence('l', 'u', *ema_terms('dn', 14))}, {recurrence('f', 'b', *ema_terms('close', 12))}, {recurrence('s', 'b', *ema_terms('close', 26))},
    m AS (SELECT symbol, rn, f.out - s.out AS m FROM f JOIN s USING (symbol, rn)), {recurrence('h', 'm', *ema_terms('m', 9))},
    z AS (SELECT u.symbol, u.ts, e.out AS e, CASE WHEN rn > 14 THEN 100 - 100 / (1 + g.out / nullif(l.out, 0)) END AS r, CASE WHEN rn > 26 THEN m.m END AS m, CASE WHEN rn >= 34 THEN h.out END AS h
        FROM u JOIN e USING (symbol, rn) JOIN g USING (symbol, rn) JOIN l USING (symbol, rn) JOIN m USING (symbol, rn) JOIN h USING (symbol, rn))
    SELECT symbol, ts, {r6('e', 'classic_ema')}, {r6('r', 'classic_rsi')}, {r6('m', 'classic_macd')}, {r6('h', 'classic_macd_signal')}, {r6('m - h', 'classic_macd_hist')} FROM z""")
on_bars("classic_windows", lambda b: classic.aroon(classic.stochastic(classic.obv(classic.mfi(classic.cci(b))))), ["classic_cci", "classic_mfi", "classic_obv", "classic_k", "classic_d", "classic_aroon_up", "classic_aroon_down"], f"""
    WITH {bars_cte()}, x AS (SELECT *, (high + low + close) / 3 AS tp FROM b), y AS (SELECT *, {full(f'avg(tp) OVER {w(20)}', 20)} AS m, tp - lag(tp) OVER ({S}) AS d, sign(close - lag(close) OVER ({S})) * volume AS o,
        {full(f'max(high) OVER {w(14)}', 14)} AS hh, {full(f'min(low) OVER {w(14)}', 14)} AS ll, list_reverse(list(high) OVER {w(25)}) AS lh, list_reverse(list(low) OVER {w(25)}) AS lw FROM x),
    z AS (SELECT *, abs(tp - m) AS ad, CASE WHEN d > 0 THEN tp * volume ELSE 0 END AS up, CASE WHEN d < 0 THEN tp * volume ELSE 0 END AS dn, 100 * (close - ll) / nullif(hh - ll, 0) AS k FROM y)
    SELECT symbol, ts, {r6('(tp - m) / nullif(0.015 * (' + full(f'avg(ad) OVER {w(20)}', 20, 'ad') + '), 0)', 'classic_cci')}, {r6(full(f'100 - 100 / (1 + sum(up) OVER {w(14)} / nullif(sum(dn) OVER {w(14)}, 0))', 14), 'classic_mfi')},
    {r6(f'sum(o) OVER {ALLW}', 'classic_obv')}, {r6('k', 'classic_k')}, {r6(full(f'avg(k) OVER {w(3)}', 3, 'k'), 'classic_d')},
    {r6('CASE WHEN len(lh) = 25 THEN (25 - list_position(lh, list_max(lh))) / 24.0 * 100 END', 'classic_aroon_up')}, {r6('CASE WHEN len(lw) = 25 THEN (25 - list_position(lw, list_min(lw))) / 24.0 * 100 END', 'classic_aroon_down')} FROM z""")
on_bars("sr_overlap_score", lambda b: lv.overlap_score(b, [10.0, 10.2, 20.0, 35.0, 50.0, 75.0, 75.5, 100.0]), ["sr_score"], f"""
    WITH {bars_cte()}, x AS (SELECT *, [s FOR s IN [1 - abs(close - v) / (close * 0.05) FOR v IN [10.0, 10.2, 20.0, 35.0, 50.0, 75.0, 75.5, 100.0]] IF s > 0] AS h FROM b)
    SELECT symbol, ts, {r6('CASE WHEN len(h) = 0 THEN 0 ELSE least(1.0, list_max(h) + 0.1 * (len(h) - 1)) END', 'sr_score')} FROM x""")
ZONE = ["z_kind", "z_bottom", "z_top", "touch_age", "fill_age", "state"]
QUERIES["zone_life"] = lambda s, d: tidy(lv.zone_life(pat.fair_value_gap(bars(s, d)), life=20).fillna(-1, ["touch_age", "fill_age"]), ["symbol", "born"], ZONE)
ORACLE_SQL["zone_life"] = f"""WITH {bars_cte()}, x AS (SELECT *, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2, row_number() OVER ({S}) AS rn FROM b), k AS (SELECT *, CASE WHEN h2 < low THEN 1 WHEN l2 > high THEN -1 ELSE 0 END AS k FROM x),
    y AS (SELECT *, lag(k) OVER ({S}) AS zk, lag(CASE k WHEN 1 THEN h2 WHEN -1 THEN high END) OVER ({S}) AS zb, lag(CASE k WHEN 1 THEN low WHEN -1 THEN l2 END) OVER ({S}) AS zt FROM k),
    j AS (SELECT z.symbol, z.ts AS born, z.zk, z.zb, z.zt, b.rn - z.rn AS age, CASE WHEN z.zk = 1 THEN b.low <= z.zt ELSE b.high >= z.zb END AS touched, CASE WHEN z.zk = 1 THEN b.close < z.zb ELSE b.close > z.zt END AS filled
        FROM y z JOIN y b ON b.symbol = z.symbol AND b.rn > z.rn AND b.rn <= z.rn + 20 WHERE z.zk <> 0),
    g AS (SELECT symbol, born, zk, zb, zt, min(age) FILTER (touched) AS ta, min(age) FILTER (filled) AS fa FROM j GROUP BY ALL)
    SELECT symbol, born, CAST(zk AS INTEGER) AS z_kind, {r6('zb', 'z_bottom')}, {r6('zt', 'z_top')}, CAST(coalesce(ta, -1) AS INTEGER) AS touch_age, CAST(coalesce(fa, -1) AS INTEGER) AS fill_age, CASE WHEN fa IS NOT NULL THEN 'filled' WHEN ta IS NOT NULL THEN 'touched' ELSE 'alive' END AS state FROM g"""


def _bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = lv.soft_bias(bars(spark, sf_dir, "H4"))
    both = j.align(lv.soft_bias(bars(spark, sf_dir)), "H1", {"H4": high}, ["bias"])
    return tidy(lv.confluence(both, "bias", "H4_bias"), ["symbol", "ts"], ["bias", "H4_bias", "conflict", "confluence"])


QUERIES["mtf_bias_confluence"] = _bias
QUERIES["fibonacci_levels"] = lambda s, d: tidy(lv.fibonacci(lv.legs(rec.zigzag(bars(s, d), 0.2)).filter("nth <= 3")), ["symbol", "nth"], ["start_ts", "end_ts", "direction", "ratio", "level"])
QUERIES["fibonacci_golden_zone"] = lambda s, d: tidy(lv.golden_zone(lv.legs(rec.zigzag(bars(s, d), 0.2))), ["symbol"], ["zone_low", "zone_high", "zone_mid", "zone_width_pct"])
QUERIES["fibonacci_targets"] = lambda s, d: tidy(lv.targets(lv.legs(rec.zigzag(bars(s, d), 0.2))), ["symbol"], ["ratio", "target", "reward_risk"])
QUERIES["fibonacci_clusters"] = lambda s, d: tidy(lv.clusters(lv.fibonacci(lv.legs(rec.zigzag(bars(s, d), 0.2)).filter("nth <= 5 AND end_price > 0")), ["symbol"], tol_pct=2.0), ["symbol", "cluster"], ["anchor", "members", "centre"])
#: Of suppliers: a profile for each, any of whose parts may stand for all.
PROFILE = {"broker": "CASE s_suppkey % 3 WHEN 0 THEN '*' ELSE CONCAT('b', s_nationkey % 4) END", "account_type": "CASE s_suppkey % 2 WHEN 0 THEN '*' ELSE CONCAT('t', s_nationkey % 3) END", "symbol": "CASE s_suppkey % 5 WHEN 0 THEN '*' ELSE CONCAT('s', s_nationkey) END"}
REQUEST = {"broker": "CONCAT('b', c_custkey % 6)", "account_type": "CONCAT('t', c_custkey % 4)", "symbol": "CONCAT('s', c_nationkey)"}


def _commission(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*(f"{e} AS {c}" for c, e in PROFILE.items()), "s_suppkey % 2 = 1 AS round_turn", "CAST(s_acctbal AS DOUBLE) AS rate")
    profiles = found.groupBy("broker", "account_type", "symbol").agg(F.min("rate").alias("rate"), F.min("round_turn").alias("round_turn"), F.lit("per_lot").alias("kind"))
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*(f"{e} AS {c}" for c, e in REQUEST.items()))
    return tidy(acc.resolve_commission(requests, profiles), ["broker", "account_type", "symbol"], ["kind", "rate"])


QUERIES["commission_profiles"] = _commission
ORACLE_SQL["commission_profiles"] = f"""WITH p AS (SELECT {PROFILE['broker']} AS pb, {PROFILE['account_type']} AS pt, {PROFILE['symbol']} AS ps, min(CAST(s_acctbal AS DOUBLE)) AS rate, bool_and(s_suppkey % 2 = 1) AS rt FROM supplier GROUP BY 1, 2, 3),
    a AS (SELECT DISTINCT {REQUEST['broker']} AS broker, {REQUEST['account_type']} AS account_type, {REQUEST['symbol']} AS symbol FROM customer),
    j AS (SELECT *, row_number() OVER (PARTITION BY broker, account_type, symbol ORDER BY (ps <> '*')::INT * 4 + (pb <> '*')::INT * 2 + (pt <> '*')::INT DESC) AS n FROM a LEFT JOIN p ON (ps = symbol OR ps = '*') AND (pb = broker OR pb = '*') AND (pt = account_type OR pt = '*'))
    SELECT broker, account_type, symbol, CASE WHEN pb IS NOT NULL THEN 'per_lot' END AS kind, {r6('CASE WHEN rt THEN rate / 2 ELSE rate END', 'rate')} FROM j WHERE n = 1"""
QUERIES["slippage_model"] = lambda s, d: tidy(acc.slippage(_fills(s, d).drop("slippage"), 0.3, 0.4, 1.0, 0.01), ["execution_id", "fill_no"], ["slippage_pips", "slippage"])

UNIFORM = lambda salt: f"((CAST('0x' || substr(md5('7:{salt}:' || CAST(execution_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 1) / {float((1 << 52) + 1)!r})"
ORACLE_SQL["slippage_model"] = f"""WITH n AS (SELECT l_orderkey AS execution_id, l_linenumber AS fill_no FROM lineitem), x AS (SELECT *, greatest(0, least(1.0, 0.3 + 0.4 * (sqrt(-2 * ln({UNIFORM('a')})) * cos(2 * pi() * {UNIFORM('b')})))) AS p FROM n)
    SELECT execution_id, fill_no, {r6('p', 'slippage_pips')}, {r6('p * 0.01', 'slippage')} FROM x"""


def _correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir, "D1").select("ts", "symbol", (F.col("close") / 400).alias("exposure"))
    pairs = x.alias("a").join(x.alias("b"), "ts").selectExpr("ts", "a.symbol symbol_a", "b.symbol symbol_b", "CASE WHEN length(a.symbol) = length(b.symbol) THEN 0.9 ELSE 0.1 END rho")
    return tidy(acc.correlation_cap(x, pairs, "ts"), ["ts", "symbol"], ["capped"])


QUERIES["correlation_cap"] = _correlation
ORACLE_SQL["correlation_cap"] = f"""WITH RECURSIVE {bars_cte('D1')}, x AS (SELECT ts, symbol, close / 400 AS e FROM b), pr AS (SELECT ts, p.symbol AS sa, q.symbol AS sb, row_number() OVER (PARTITION BY ts ORDER BY p.symbol, q.symbol) AS n FROM x p JOIN x q USING (ts) WHERE p.symbol < q.symbol AND length(p.symbol) = length(q.symbol)),
    f AS (SELECT ts, CAST(0 AS BIGINT) AS n, list(symbol ORDER BY symbol) AS s, list(e ORDER BY symbol) AS v FROM x GROUP BY ts
        UNION ALL SELECT g.ts, g.n, g.s, list_transform(g.v, lambda y, i: CASE WHEN (g.s[i] = g.sa OR g.s[i] = g.sb) AND g.t > 0.4 THEN y * 0.4 / g.t ELSE y END)
        FROM (SELECT f.ts, pr.n, f.s, f.v, sa, sb, abs(f.v[list_position(f.s, sa)]) + abs(f.v[list_position(f.s, sb)]) AS t FROM f JOIN pr ON pr.ts = f.ts AND pr.n = f.n + 1) g),
    l AS (SELECT ts, arg_max(s, n) AS s, arg_max(v, n) AS v FROM f GROUP BY ts), u AS (SELECT ts, unnest(s) AS symbol, unnest(v) AS v FROM l) SELECT ts, symbol, {r6('v', 'capped')} FROM u"""
QUERIES["trade_intents"] = lambda s, d: tidy(acc.intents(roll.roc(bars(s, d), period=3).selectExpr("symbol", "ts", "close price", "10000D equity", "coalesce(roc, 0) / 100 exposure", "CAST(volume AS DOUBLE) * 100 held")), ["symbol", "ts"], ["target_lots", "side", "trade_lots", "action"])
ORACLE_SQL["trade_intents"] = f"""WITH {bars_cte()}, x AS (SELECT symbol, ts, close AS p, coalesce((close - lag(close, 3) OVER ({S})) / nullif(lag(close, 3) OVER ({S}), 0) * 100, 0) / 100 AS e, CAST(volume AS DOUBLE) * 100 AS h FROM b), y AS (SELECT *, 10000 * e / nullif(p, 0) AS t FROM x)
    SELECT symbol, ts, {r6('t', 'target_lots')}, CAST(sign(t - h) AS INTEGER) AS side, {r6('abs(t - h)', 'trade_lots')}, CASE WHEN h = t THEN 'HOLD' WHEN h = 0 THEN 'OPEN' WHEN t = 0 THEN 'CLOSE' WHEN sign(h) <> sign(t) THEN 'REVERSE' WHEN abs(t) > abs(h) THEN 'INCREASE' ELSE 'REDUCE' END AS action FROM y"""
QUERIES["flag_rates"] = lambda s, d: tidy(acc.flag_rate_proposals(pat.all_patterns(bars(s, d)), _pattern_sql.names[:6], 0.02, 0.2, 0.05), ["flag"], ["rate", "shift"])
ORACLE_SQL["flag_rates"] = "WITH p AS (" + ORACLE_SQL["candle_patterns"] + "), r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS flag, avg({n}) AS rate FROM p" for n in _pattern_sql.names[:6]) + f") SELECT flag, {r6('rate', 'rate')}, {r6('CASE WHEN rate < 0.02 THEN -0.05 WHEN rate > 0.2 THEN 0.05 ELSE 0 END', 'shift')} FROM r"

# -- SQL for state machines: one step of recursion for each bar -------------------------

ORACLE_SQL["parabolic_sar"] = f"""WITH RECURSIVE {NB}, p AS (SELECT symbol, rn, low AS sar, high AS ep, 0.02::DOUBLE AS af, true AS up FROM b WHERE rn = 1 UNION ALL
    SELECT symbol, rn, CASE WHEN x THEN e1 ELSE s1 END, CASE WHEN x THEN CASE WHEN up THEN low ELSE high END ELSE e1 END, CASE WHEN x THEN 0.02 ELSE a1 END, up <> x FROM (
        SELECT *, CASE WHEN e1 <> ep THEN least(af + 0.02, 0.2) ELSE af END AS a1, CASE WHEN up THEN low < s1 ELSE high > s1 END AS x FROM (
            SELECT b.symbol, b.rn, b.high, b.low, p.ep, p.af, p.up, p.sar + p.af * (p.ep - p.sar) AS s1, CASE WHEN p.up THEN greatest(p.ep, b.high) ELSE least(p.ep, b.low) END AS e1 FROM p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)))
    SELECT symbol, ts, {r6('CASE WHEN rn > 1 THEN sar END', 'psar')} FROM b JOIN p USING (symbol, rn)"""


def supertrend_sql(judge: str) -> str:
    return f"""WITH RECURSIVE {NB}, {recurrence('a', 'b', *seed_terms('tr', 10, 1 / 10))}, x AS (SELECT b.symbol, b.ts, b.rn, close, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS was, (high + low) / 2 + 3 * a.out AS top, (high + low) / 2 - 3 * a.out AS bot FROM b JOIN a USING (symbol, rn)),
    s AS (SELECT symbol, rn, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS l, 1 AS d FROM x WHERE rn = 1 UNION ALL
        SELECT symbol, rn, u1, l1, CASE WHEN NOT fresh AND (CASE WHEN d = 1 THEN close <= l1 ELSE close >= u1 END) THEN -d ELSE d END FROM (
            SELECT x.symbol, x.rn, x.close, s.d, s.u IS NULL AS fresh, CASE WHEN x.top IS NULL THEN s.u WHEN s.u IS NULL OR x.{judge} > s.u THEN x.top ELSE least(x.top, s.u) END AS u1,
                CASE WHEN x.top IS NULL THEN s.l WHEN s.l IS NULL OR x.{judge} < s.l THEN x.bot ELSE greatest(x.bot, s.l) END AS l1 FROM s JOIN x ON x.symbol = s.symbol AND x.rn = s.rn + 1))
    SELECT symbol, ts, {r6('CASE WHEN top IS NOT NULL THEN CASE WHEN d = 1 THEN l ELSE u END END', 'supertrend')}, {r6('d', 'supertrend_dir')} FROM x JOIN s USING (symbol, rn)"""


ORACLE_SQL["supertrend"], ORACLE_SQL["supertrend_older"] = supertrend_sql("was"), supertrend_sql("close")
ZIGZAG = f"""{NB}, z AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS lo, 0 AS t, 0 AS zz, CAST(NULL AS DOUBLE) AS price FROM b UNION ALL
    SELECT symbol, rn, CASE WHEN c2 THEN high ELSE h1 END, CASE WHEN c1 THEN low ELSE l1 END, CASE WHEN c1 THEN -1 WHEN c2 THEN 1 ELSE t END, CASE WHEN c1 THEN 1 WHEN c2 THEN -1 ELSE 0 END, CASE WHEN c1 THEN h1 WHEN c2 THEN l1 END FROM (
        SELECT *, NOT c1 AND t <= 0 AND high >= l1 * 1.2 AS c2 FROM (SELECT *, t >= 0 AND low <= h1 * (1 - 0.2) AS c1 FROM (
            SELECT b.symbol, b.rn, b.high, b.low, z.t, CASE WHEN z.t >= 0 THEN greatest(z.hi, b.high) ELSE z.hi END AS h1, CASE WHEN z.t <= 0 THEN least(z.lo, b.low) ELSE z.lo END AS l1 FROM z JOIN b ON b.symbol = z.symbol AND b.rn = z.rn + 1)))),
    zz AS (SELECT symbol, ts, rn, close, zz, price FROM b JOIN z USING (symbol, rn))"""
PASTW = f"({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LASTZ = lambda k, win: f"last_value(CASE WHEN zz = {k} THEN price END IGNORE NULLS) OVER {win}"
ORACLE_SQL["market_structure"] = f"""WITH RECURSIVE {ZIGZAG}, l AS (SELECT *, {LASTZ(1, ALLW)} AS lh, {LASTZ(-1, ALLW)} AS ll, {LASTZ(1, PASTW)} AS ph, {LASTZ(-1, PASTW)} AS pl FROM zz),
    e AS (SELECT *, CASE WHEN close >= lh * (1 + 1e-6) THEN 1 WHEN close <= ll * (1 - 1e-6) THEN -1 END AS e FROM l),
    r AS (SELECT *, last_value(e IGNORE NULLS) OVER {PASTW} AS r0, last_value(e IGNORE NULLS) OVER {ALLW} AS r1 FROM e)
    SELECT symbol, ts, {r6('zz', 'zz')}, {r6('price', 'zz_price')}, CASE WHEN zz = 1 AND price > ph THEN 'HH' WHEN zz = 1 AND price < ph THEN 'LH' WHEN zz = -1 AND price > pl THEN 'HL' WHEN zz = -1 AND price < pl THEN 'LL' ELSE '' END AS structure,
    CAST(CASE WHEN e = coalesce(r0, 0) THEN e ELSE 0 END AS INTEGER) AS bos, CAST(CASE WHEN e IS NOT NULL AND e <> coalesce(r0, 0) THEN e ELSE 0 END AS INTEGER) AS choch, CAST(coalesce(r1, 0) AS INTEGER) AS regime FROM r"""
LEGS = f"""{ZIGZAG}, sw AS (SELECT *, lag(ts) OVER ({S}) AS t0, lag(price) OVER ({S}) AS p0 FROM zz WHERE zz <> 0),
    legs AS (SELECT symbol, t0 AS start_ts, ts AS end_ts, p0, price AS p1, zz AS direction, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM sw WHERE t0 IS NOT NULL)"""
RATIOS = "(SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]) AS ratio)"
ORACLE_SQL["fibonacci_levels"] = f"WITH RECURSIVE {LEGS} SELECT symbol, CAST(nth AS INTEGER) AS nth, start_ts, end_ts, CAST(direction AS INTEGER) AS direction, ratio, {r6('p1 - ratio * (p1 - p0)', 'level')} FROM legs, {RATIOS} WHERE nth <= 3"
ORACLE_SQL["fibonacci_golden_zone"] = f"""WITH RECURSIVE {LEGS}, g AS (SELECT symbol, p1 - 0.382 * (p1 - p0) AS a, p1 - 0.618 * (p1 - p0) AS b FROM legs WHERE nth = 1)
    SELECT symbol, {r6('least(a, b)', 'zone_low')}, {r6('greatest(a, b)', 'zone_high')}, {r6('(least(a, b) + greatest(a, b)) / 2', 'zone_mid')}, {r6('100 * (greatest(a, b) - least(a, b)) / nullif((least(a, b) + greatest(a, b)) / 2, 0)', 'zone_width_pct')} FROM g"""
ORACLE_SQL["fibonacci_targets"] = f"WITH RECURSIVE {LEGS} SELECT symbol, ratio, {r6('p0 + ratio * (p1 - p0)', 'target')}, {r6('abs(p0 + ratio * (p1 - p0) - p1) / nullif(abs(p1 - p0), 0)', 'reward_risk')} FROM legs, (SELECT unnest([1.272, 1.618, 2.0]::DOUBLE[]) AS ratio) WHERE nth = 1"
ORACLE_SQL["fibonacci_clusters"] = f"""WITH RECURSIVE {LEGS}, v AS (SELECT symbol, p1 - ratio * (p1 - p0) AS level FROM legs, {RATIOS} WHERE nth <= 5 AND p1 > 0),
    c AS (SELECT symbol, CAST(0 AS INTEGER) AS k, min(level) AS anchor FROM v GROUP BY symbol UNION ALL SELECT c.symbol, c.k + 1, (SELECT min(level) FROM v WHERE v.symbol = c.symbol AND level > c.anchor * (1 + 2.0 / 100)) FROM c WHERE c.anchor IS NOT NULL)
    SELECT c.symbol, k AS cluster, {r6('anchor', 'anchor')}, CAST(count(*) AS INTEGER) AS members, {r6('avg(level)', 'centre')} FROM c JOIN v ON v.symbol = c.symbol AND level >= anchor AND level <= anchor * (1 + 2.0 / 100) WHERE anchor IS NOT NULL GROUP BY c.symbol, k, anchor"""


def _bias_cte(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT *, close - lag(close) OVER ({S}) AS c FROM {source}), {name}_s AS (SELECT *, CASE WHEN count(c) OVER {w(8)} >= 4 THEN sum(c) OVER {w(8)} END AS s FROM {name}_c),
    {name} AS (SELECT symbol, ts, greatest(-2, least(2, CASE WHEN count(s) OVER {w(8)} >= 4 THEN (s - quantile_cont(s, 0.5) OVER {w(8)}) / nullif(quantile_cont(s, 0.75) OVER {w(8)} - quantile_cont(s, 0.25) OVER {w(8)}, 0) END)) / 2 AS raw,
        count(s) OVER {w(8)} >= 4 AND s IS NOT NULL AND quantile_cont(s, 0.75) OVER {w(8)} > quantile_cont(s, 0.25) OVER {w(8)} AS ok FROM {name}_s)"""


ORACLE_SQL["mtf_bias_confluence"] = f"""WITH {bars_cte()}, {H4}, {_bias_cte('lo', 'b')}, {_bias_cte('hi', 'h4')}, x AS (SELECT symbol, ts + INTERVAL 60 MINUTE AS at, ts, CASE WHEN ok THEN raw END AS v FROM lo), y AS (SELECT symbol, ts + INTERVAL 240 MINUTE AS at, CASE WHEN ok THEN raw END AS v FROM hi)
    SELECT x.symbol, x.ts, {r6('x.v', 'bias')}, {r6('y.v', '"H4_bias"')}, CAST(coalesce(sign(x.v) * sign(y.v) < 0, false) AS INTEGER) AS conflict, {r6('1 - abs(x.v - y.v) / 2', 'confluence')} FROM x ASOF LEFT JOIN y ON x.symbol = y.symbol AND x.at >= y.at"""
DIV = lambda kind, a, c: f"CAST(CASE WHEN pv = {kind} AND close {a} last_value(CASE WHEN pv = {kind} THEN close END IGNORE NULLS) OVER {PASTW} AND rsi {c} last_value(CASE WHEN pv = {kind} THEN rsi END IGNORE NULLS) OVER {PASTW} THEN 1 ELSE 0 END AS INTEGER)"
ORACLE_SQL["divergence"] = f"""WITH RECURSIVE {NB}, u AS (SELECT symbol, ts, rn, close, greatest(d, 0) AS up, greatest(-d, 0) AS dn, list_reverse(list(close) OVER {w(5)}) AS v FROM b), {recurrence('g', 'u', *seed_terms('up', 14, 2 / 15, 1))}, {recurrence('l', 'u', *seed_terms('dn', 14, 2 / 15, 1))},
    x AS (SELECT symbol, ts, close, {RSI} AS rsi, CASE WHEN len(v) = 5 AND list_position(v, list_max(v)) = 3 THEN 1 WHEN len(v) = 5 AND list_position(v, list_min(v)) = 3 THEN -1 ELSE 0 END AS pv FROM u JOIN g USING (symbol, rn) JOIN l USING (symbol, rn))
    SELECT symbol, ts, {DIV(1, '>', '<')} AS div_bear, {DIV(-1, '<', '>')} AS div_bull FROM x"""

# -- simulated account ----------------------------------------------------------------

SIM = ["held", "entry_price", "realised", "balance", "unrealised", "equity"]


def _simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lots in eighths, so that positions close exactly
    fills = acc.fill_costs(_fills(spark, sf_dir).withColumn("lots", F.ceil(F.col("lots") * 8) / 8))
    done = acc.mark_to_market(acc.simulate(fills, ("account",), tuple(ORDER), 10_000.0))
    return tidy(done, ["account", "execution_id", "fill_no"], SIM)


QUERIES["simulated_account"] = _simulate
ORACLE_SQL["simulated_account"] = f"""WITH RECURSIVE {FILLS_SQL.replace("CAST(l_quantity AS DOUBLE) / 100 AS lots", "ceil(CAST(l_quantity AS DOUBLE) / 100 * 8) / 8 AS lots")},
    n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, execution_id, fill_no) AS rn FROM c),
    s AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS h, 0.0::DOUBLE AS e, 0.0::DOUBLE AS g FROM n UNION ALL
        SELECT n.account, n.rn, s.h + side * lots, CASE WHEN s.h * side >= 0 THEN (abs(s.h) * s.e + lots * fill_price) / (abs(s.h) + lots) WHEN lots > abs(s.h) THEN fill_price WHEN lots < abs(s.h) THEN s.e ELSE 0 END,
            CASE WHEN s.h * side >= 0 THEN 0 ELSE (fill_price - s.e) * sign(s.h) * least(abs(s.h), lots) END FROM s JOIN n ON n.account = s.account AND n.rn = s.rn + 1),
    b AS (SELECT n.*, s.h, s.e, s.g, 10000 + sum(s.g - commission) OVER ({A}) AS balance FROM (SELECT *, 0 AS x FROM n) n JOIN s USING (account, rn)),
    u AS (SELECT *, CASE WHEN h = 0 THEN 0 ELSE (CASE WHEN h >= 0 THEN p - 0.5 ELSE p + 0.5 END - e) * h END AS u FROM b)
    SELECT account, execution_id, fill_no, {r6('h', 'held')}, {r6('e', 'entry_price')}, {r6('g', 'realised')}, {r6('balance', 'balance')}, {r6('u', 'unrealised')}, {r6('balance + u', 'equity')} FROM u"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = roll.roc(bars(spark, sf_dir, "H4"), period=3).filter("roc IS NOT NULL").selectExpr("symbol", "ts", "roc / 100 exposure", "10000D - 40 * day(ts) * hour(ts) equity", "30D * hour(ts) * day(ts) used_margin")
    asked = asked.selectExpr("*", "equity - used_margin free_margin", "equity / nullif(used_margin, 0D) margin_level")
    return tidy(acc.decide(asked, "ts").fillna("", ["violation"]), ["symbol", "ts"], ["exposure", "violation", "final", "verdict"])


QUERIES["risk_decisions"] = _decisions
ORACLE_SQL["risk_decisions"] = f"""WITH {H4}, x AS (SELECT symbol, ts, (close - lag(close, 3) OVER ({S})) / nullif(lag(close, 3) OVER ({S}), 0) * 100 / 100 AS e, 10000.0::DOUBLE - 40 * day(ts) * hour(ts) AS eq, 30.0::DOUBLE * hour(ts) * day(ts) AS used FROM h4),
    y AS (SELECT *, eq - used AS free, sign(e) * least(abs(e), 0.3) AS c, CASE WHEN eq <= 0 THEN 'EQUITY_NOT_POSITIVE' WHEN eq - used < 0 THEN 'NO_FREE_MARGIN' WHEN used < 0 THEN 'BAD_USED_MARGIN' WHEN used / nullif(eq, 0) > 0.5 THEN 'MARGIN_UTILISATION' WHEN eq / nullif(used, 0) < 1.5 THEN 'MARGIN_LEVEL' END AS v FROM x WHERE e IS NOT NULL),
    z AS (SELECT *, sum(abs(c)) OVER (PARTITION BY ts) AS t FROM y), f AS (SELECT *, CASE WHEN t > 1 THEN c / t ELSE c END AS f FROM z), n AS (SELECT *, sum(abs(f) * eq / 30) OVER (PARTITION BY ts) AS need FROM f),
    o AS (SELECT *, CASE WHEN v IS NOT NULL THEN 0 WHEN need > free * 0.02 THEN f * (free * 0.02) / need ELSE f END AS g FROM n)
    SELECT symbol, ts, {r6('e', 'exposure')}, coalesce(v, '') AS violation, {r6('g', 'final')}, CASE WHEN v IS NOT NULL THEN 'REJECTED' WHEN g = e THEN 'APPROVED' ELSE 'MODIFIED' END AS verdict FROM o"""

# -- ordered decisions --------------------------------------------------------------------------

LIMITS = dec.Limits(total_exposure=0.8, symbol_exposure=0.3, symbol_concentration=0.25, margin_utilisation=0.1, portfolio_risk=0.45, correlation=0.8, correlated_exposure=0.35, open_positions=8, positions_per_symbol=3)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each H4 bar time is a decision over the symbols that have a bar then."""
    asked = roll.roc(bars(spark, sf_dir, "H4"), period=3).filter("roc IS NOT NULL").selectExpr(
        "ts", "symbol", "roc / 100 target", "roc / 100 * 0.9 capital", "volume * 100D margin", "CASE WHEN volume % 3 = 0 THEN 0D ELSE (volume % 4) * 0.1D END current", "(volume % 5) * 300D current_margin",
        "CAST(volume % 5 AS INT) positions", "CASE WHEN volume % 2 = 0 THEN 0.3D END margin_rate", "CASE WHEN volume % 7 = 0 THEN 0.02D END stop_lots", "close * 100 lot_value",
    )
    accounts = asked.select("ts").distinct().selectExpr(
        "ts", "10000D - 40 * day(ts) * hour(ts) equity", "30D * hour(ts) * day(ts) used_margin", "10000D - 70 * day(ts) * hour(ts) free_margin", "10000D margin_level", "100D leverage", "day(ts) / 150D drawdown", "hour(ts) / 500D daily_drawdown", "day(ts) * 0.016D portfolio_risk", "day(ts) = 13 AND hour(ts) = 8 blocked",
    )
    pairs = asked.alias("a").join(asked.alias("b"), "ts").filter("a.symbol < b.symbol").selectExpr("ts", "a.symbol symbol_a", "b.symbol symbol_b", "CASE WHEN length(a.symbol) = length(b.symbol) THEN 0.9 ELSE 0.1 END rho")
    return dec.evaluate(accounts, asked, "ts", LIMITS, pairs)


def _ordered_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ordered(spark, sf_dir).selectExpr("ts", "verdict", "array_join(transform(notes, n -> concat_ws(':', n.code, n.symbol)), ',') AS notes", "exposure", "margin", "positions")
    return tidy(out, ["ts"], ["verdict", "notes", "exposure", "margin", "positions"])


QUERIES["ordered_decisions"] = _ordered_verdicts
QUERIES["ordered_targets"] = lambda s, d: tidy(dec.targets(_ordered(s, d), "ts"), ["ts", "symbol"], ["target", "capital", "margin"])
QUERIES["ordered_changes"] = lambda s, d: tidy(dec.audit(_ordered(s, d), "ts"), ["ts", "code", "symbol", "field"], ["requested", "final"])
_OF = "OVER (PARTITION BY ts)"
_MARGIN = lambda t: f"CASE WHEN abs({t}) <= 1e-12 THEN 0 WHEN rate IS NOT NULL THEN abs({t}) * eq * rate WHEN abs(cur) > 1e-12 THEN cm * abs({t}) / abs(cur) ELSE 0 END"
_CAP = lambda v, most: f"CASE WHEN abs({v}) > {most} THEN sign({v}) * {most} ELSE {v} END"
ORDERED_SQL = f"""WITH RECURSIVE {H4}, r AS (SELECT *, lag(close, 3) OVER ({S}) AS l3 FROM h4),
    x AS (SELECT ts, symbol, (close - l3) / nullif(l3, 0) * 100 / 100 AS t0, (close - l3) / nullif(l3, 0) * 100 / 100 * 0.9 AS c0, volume * 100.0::DOUBLE AS mg, CASE WHEN volume % 3 = 0 THEN 0 ELSE (volume % 4) * 0.1::DOUBLE END AS cur, (volume % 5) * 300.0::DOUBLE AS cm,
        volume % 5 AS pos, CASE WHEN volume % 2 = 0 THEN 0.3::DOUBLE END AS rate, CASE WHEN volume % 7 = 0 THEN 0.02::DOUBLE END AS stop, close * 100 AS lot, 10000.0::DOUBLE - 40 * day(ts) * hour(ts) AS eq, 10000.0::DOUBLE - 70 * day(ts) * hour(ts) AS free FROM r WHERE l3 IS NOT NULL AND l3 <> 0),
    g AS (SELECT *, CASE WHEN eq <= 0 THEN 'NO_USABLE_CAPITAL' WHEN free < 0 THEN 'INSUFFICIENT_FREE_MARGIN' WHEN day(ts) = 13 AND hour(ts) = 8 THEN 'RISK_BLOCKED' WHEN day(ts) / 150.0::DOUBLE >= 0.2 THEN 'MAX_DRAWDOWN' WHEN hour(ts) / 500.0::DOUBLE >= 0.05 THEN 'MAX_DAILY_DRAWDOWN' WHEN day(ts) * 0.016::DOUBLE > 0.45 THEN 'MAX_PORTFOLIO_RISK' END AS guard,
        {_CAP('t0', 0.3)} AS t1 FROM x),
    w AS (SELECT *, sum(abs(t1)) {_OF} AS whole FROM g), s AS (SELECT *, CASE WHEN whole > 0.8 THEN t1 * 0.8 / whole ELSE t1 END AS t2 FROM w),
    pr AS (SELECT ts, p.symbol AS sa, q.symbol AS sb, row_number() OVER (PARTITION BY ts ORDER BY p.symbol, q.symbol) AS n FROM x p JOIN x q USING (ts) WHERE p.symbol < q.symbol AND length(p.symbol) = length(q.symbol)),
    f AS (SELECT ts, CAST(0 AS BIGINT) AS n, 0 AS hits, list(symbol ORDER BY symbol) AS s, list(t2 ORDER BY symbol) AS v FROM s GROUP BY ts
        UNION ALL SELECT k.ts, k.n, k.hits + CAST(k.t > 0.35 AS INTEGER), k.s, list_transform(k.v, lambda y, i: CASE WHEN (k.s[i] = k.sa OR k.s[i] = k.sb) AND k.t > 0.35 THEN y * 0.35 / k.t ELSE y END)
        FROM (SELECT f.ts, pr.n, f.hits, f.s, f.v, sa, sb, abs(f.v[list_position(f.s, sa)]) + abs(f.v[list_position(f.s, sb)]) AS t FROM f JOIN pr ON pr.ts = f.ts AND pr.n = f.n + 1) k),
    l AS (SELECT ts, arg_max(s, n) AS s, arg_max(v, n) AS v, max(hits) AS hits FROM f GROUP BY ts), c AS (SELECT ts, hits, unnest(s) AS symbol, unnest(v) AS t3 FROM l),
    m AS (SELECT s.*, c.t3, c.hits, {_CAP('s.c0', 0.25)} AS c1 FROM s JOIN c USING (ts, symbol)), n AS (SELECT *, sum({_MARGIN('t3')}) {_OF} AS need FROM m),
    k AS (SELECT *, need > 0 AND eq > 0 AND need / eq > 0.1 AS tight, least(1.0, greatest(0.0, 0.1 * eq / nullif(need, 0))) AS factor FROM n),
    o AS (SELECT *, CASE WHEN tight THEN t3 * factor ELSE t3 END AS t4, CASE WHEN tight THEN c1 * factor ELSE c1 END AS c2, CASE WHEN tight THEN mg * factor ELSE mg END AS mg2 FROM k),
    u AS (SELECT *, abs(t4) * eq / nullif(lot, 0) AS lots FROM o), e AS (SELECT *, abs(t4) > 1e-12 AND lots > stop AS over, CASE WHEN abs(t4) > 1e-12 AND lots > stop THEN t4 * (stop / lots) ELSE t4 END AS t5 FROM u),
    z AS (SELECT *, {_MARGIN('t5')} AS own, CASE WHEN abs(t5) <= 1e-12 THEN 0 WHEN abs(cur) <= 1e-12 THEN 1 ELSE pos END AS npos FROM e),
    d AS (SELECT ts, any_value(guard) AS guard, sum(abs(t5)) AS exposure, sum(own) AS margin, CAST(sum(npos) AS INTEGER) AS positions, any_value(eq) AS eq, min(symbol) FILTER (npos > 3) AS crowded,
        list_concat(coalesce(list('MAX_SYMBOL_EXPOSURE:' || symbol ORDER BY symbol) FILTER (abs(t0) > 0.3), []), CASE WHEN any_value(whole) > 0.8 THEN ['MAX_TOTAL_EXPOSURE'] ELSE [] END, [CAST('MAX_CORRELATED_EXPOSURE' AS VARCHAR) FOR i IN range(any_value(hits))],
            coalesce(list('MAX_SYMBOL_CONCENTRATION:' || symbol ORDER BY symbol) FILTER (abs(c0) > 0.25), []), CASE WHEN bool_or(tight) THEN ['MAX_MARGIN_UTILISATION'] ELSE [] END, coalesce(list('STOP_LOSS_RISK_CAP:' || symbol ORDER BY symbol) FILTER (over), [])) AS warned FROM z GROUP BY ts),
    v AS (SELECT *, CASE WHEN positions > 8 THEN 'MAX_OPEN_POSITIONS' WHEN crowded IS NOT NULL THEN 'MAX_POSITIONS_PER_SYMBOL:' || crowded WHEN eq - margin <= 0 THEN 'NO_FREE_MARGIN' END AS refused FROM d)"""
ORACLE_SQL["ordered_decisions"] = f"""{ORDERED_SQL}
    SELECT ts, CASE WHEN guard IS NOT NULL OR refused IS NOT NULL THEN 'REJECTED' WHEN len(warned) > 0 THEN 'MODIFIED' ELSE 'APPROVED' END AS verdict,
        CASE WHEN guard IS NOT NULL THEN guard ELSE array_to_string(CASE WHEN refused IS NOT NULL THEN list_append(warned, refused) ELSE warned END, ',') END AS notes, {r6('exposure', 'exposure')}, {r6('margin', 'margin')}, positions FROM v"""
ORACLE_SQL["ordered_targets"] = f"{ORDERED_SQL} SELECT z.ts, symbol, {r6('t5', 'target')}, {r6('c2', 'capital')}, {r6('mg2', 'margin')} FROM z JOIN v USING (ts) WHERE v.guard IS NULL AND v.refused IS NULL"
_CHANGES = [("MAX_SYMBOL_EXPOSURE", "target", "t0", "t1"), ("MAX_TOTAL_EXPOSURE", "target", "t1", "t2"), ("MAX_CORRELATED_EXPOSURE", "target", "t2", "t3"), ("MAX_SYMBOL_CONCENTRATION", "capital", "c0", "c1"), *(("MAX_MARGIN_UTILISATION", n, a, b) for n, a, b in (("target", "t3", "t4"), ("capital", "c1", "c2"), ("margin", "mg", "mg2"))), ("STOP_LOSS_RISK_CAP", "target", "t4", "t5")]
ORACLE_SQL["ordered_changes"] = f"{ORDERED_SQL}, ch AS ({' UNION ALL '.join(f"""SELECT ts, '{code}' AS code, symbol, '{field}' AS field, {a} AS a, {b} AS b FROM z WHERE guard IS NULL AND {a} IS DISTINCT FROM {b}""" for code, field, a, b in _CHANGES)}) SELECT ts, code, symbol, field, {r6('a', 'requested')}, {r6('b', 'final')} FROM ch"

# -- structure and zones -----------------------------------------------------------------

LAST = lambda v, over: f"last_value({v} IGNORE NULLS) OVER {over}"
SWINGS_SQL = f"""{bars_cte()}, w7 AS (SELECT *, count(*) OVER {w(7)} = 7 AS whole, lag(high, 3) OVER ({S}) AS h, lag(low, 3) OVER ({S}) AS l, max(high) OVER {w(7)} AS mh, min(low) OVER {w(7)} AS ml FROM b),
    sw AS (SELECT *, CASE WHEN whole AND h = mh THEN h END AS sh, CASE WHEN whole AND l = ml THEN l END AS sl FROM w7)"""
on_bars("swing_trend", lambda b: st.swing_trend(st.swings(b, 3, 3)), ["swing_high", "swing_low", "trend", "trend_bos", "trend_choch"], f"""
    WITH {SWINGS_SQL}, m AS (SELECT *, max(sh) OVER {PASTW} AS top, min(sl) OVER {PASTW} AS floor FROM sw),
    v AS (SELECT *, CASE WHEN sh > top THEN 1 WHEN sh < top THEN -1 END AS vh, CASE WHEN sl < floor THEN -1 WHEN sl > floor THEN 1 END AS vl FROM m), u AS (SELECT *, coalesce(vl, vh) AS says FROM v),
    t AS (SELECT *, coalesce({LAST('says', PASTW)}, 0) AS was, coalesce({LAST('says', ALLW)}, 0) AS trend FROM u),
    k AS (SELECT *, CASE WHEN vl = 1 AND coalesce(vh, was) <> 1 THEN 1 WHEN vh = -1 AND was <> -1 THEN -1 END AS br FROM t), q AS (SELECT *, {LAST('br', PASTW)} AS lb FROM k)
    SELECT symbol, ts, {r6('sh', 'swing_high')}, {r6('sl', 'swing_low')}, CAST(trend AS INTEGER) AS trend, CAST(CASE WHEN lb IS NULL OR lb = br THEN coalesce(br, 0) ELSE 0 END AS INTEGER) AS trend_bos, CAST(CASE WHEN lb <> br THEN br ELSE 0 END AS INTEGER) AS trend_choch FROM q""")
on_bars("gap_register", st.gap_register, ["gap_new", "gaps_filled", "gaps_open"], f"""
    WITH {bars_cte()}, x AS (SELECT *, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2, row_number() OVER ({S}) AS rn FROM b),
    g AS (SELECT *, CASE WHEN low > h2 THEN 1 WHEN high < l2 THEN -1 ELSE 0 END AS k, CASE WHEN low > h2 THEN h2 WHEN high < l2 THEN l2 END AS edge FROM x),
    f AS (SELECT a.symbol, a.rn AS born, min(z.rn) AS rn FROM g a JOIN g z ON a.symbol = z.symbol AND z.rn > a.rn AND ((a.k = 1 AND z.low <= a.edge) OR (a.k = -1 AND z.high >= a.edge)) GROUP BY ALL),
    n AS (SELECT symbol, rn, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (symbol, rn))
    SELECT symbol, ts, {r6('k', 'gap_new')}, {r6('n', 'gaps_filled')}, {r6(f'sum(abs(k) - n) OVER {ALLW}', 'gaps_open')} FROM c""")


def _soft(b: DataFrame) -> DataFrame:
    b = st.swings(roll.atr_classic(b), 3, 3)
    b = b.withColumns({"sw": F.when(F.col("swing_high").isNotNull(), 1).when(F.col("swing_low").isNotNull(), -1).otherwise(0), "sw_price": F.coalesce("swing_high", "swing_low")})
    return st.soft_confirmations(b, "sw", "sw_price", 5.0)


SOFT = ["sc_deviation", "sc_time", "sc_structure", "sc_atr", "soft_strength", "pivot_age", "pivot_distance"]
on_bars("soft_confirmations", _soft, SOFT, f"""
    WITH {SWINGS_SQL}, t AS (SELECT *, {TR} AS tr, row_number() OVER ({S}) AS rn, CASE WHEN sh IS NOT NULL THEN 1 WHEN sl IS NOT NULL THEN -1 ELSE 0 END AS k, coalesce(sh, sl) AS p FROM sw),
    x AS (SELECT *, {ATR14} AS a, {LAST('CASE WHEN k <> 0 THEN k END', ALLW)} AS lk, {LAST('CASE WHEN k <> 0 THEN p END', ALLW)} AS lp, rn - {LAST('CASE WHEN k <> 0 THEN rn END', ALLW)} AS age,
        {LAST('CASE WHEN k = 1 THEN p END', PASTW)} AS ph, {LAST('CASE WHEN k = -1 THEN p END', PASTW)} AS pl FROM t), y AS (SELECT *, CASE WHEN lk = -1 THEN high - lp ELSE lp - low END AS gone FROM x),
    z AS (SELECT symbol, ts, CAST(coalesce(gone >= 5, false) AS INTEGER) AS d, CAST(coalesce(age >= 10, false) AS INTEGER) AS t, CAST(coalesce(k = 1 AND p < ph OR k = -1 AND p > pl, false) AS INTEGER) AS s, CAST(coalesce(gone >= 1.5 * a, false) AS INTEGER) AS v, age, abs(close - lp) AS dist FROM y)
    SELECT symbol, ts, d AS sc_deviation, t AS sc_time, s AS sc_structure, v AS sc_atr, d + t + s + v AS soft_strength, CAST(age AS INTEGER) AS pivot_age, {r6('dist', 'pivot_distance')} FROM z""")
on_bars("level_breaks", lambda b: st.level_breaks(b.withColumns({"hi": roll.highest("high", 20), "lo": roll.lowest("low", 20)}).withColumns({"r": roll.prev("hi"), "s": roll.prev("lo")}), "r", "s"), ["level_break", "break_confirmed"], f"""
    WITH {bars_cte()}, c AS (SELECT *, {full(f'max(high) OVER {w(20)}', 20)} AS hi, {full(f'min(low) OVER {w(20)}', 20)} AS lo, avg(volume) OVER ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM b),
    k AS (SELECT *, CASE WHEN close > lag(hi) OVER ({S}) THEN 1 WHEN close < lag(lo) OVER ({S}) THEN -1 ELSE 0 END AS k FROM c)
    SELECT symbol, ts, CAST(k AS INTEGER) AS level_break, CAST(coalesce(k <> 0 AND volume > 1.5 * usual, false) AS INTEGER) AS break_confirmed FROM k""")
on_bars("trend_regime", lambda b: st.trend_regime(roll.atr_classic(b).selectExpr("*", "100 * abs(close - open) / close adx", "(high - low) / nullif(atr, 0D) atr_ratio", "close - open slope")), ["market_regime", "regime_strength", "regime_duration"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT *, 100 * abs(close - open) / close AS adx, (high - low) / nullif({ATR14}, 0) AS r FROM t),
    m AS (SELECT *, CASE WHEN adx >= 25 THEN CASE WHEN close < open THEN 'trending_down' ELSE 'trending_up' END WHEN r >= 0.8 THEN 'volatile' ELSE 'ranging' END AS m FROM x),
    f AS (SELECT *, CAST(m = coalesce(lag(m) OVER ({S}), 'ranging') AS INTEGER) AS same FROM m), {run_sql('same', 'f', 'lasts')}
    SELECT symbol, ts, m AS market_regime, {r6("CASE m WHEN 'volatile' THEN r WHEN 'ranging' THEN 1 - adx / 25 ELSE least(adx / 50, 1) END", 'regime_strength')}, CAST(lasts AS BIGINT) AS regime_duration FROM lasts_t""")
on_bars("volatility_threshold", st.volatility_threshold, ["vol_regime", "vol_threshold"], f"""
    WITH RECURSIVE {NB}, {recurrence('a', 'b', *seed_terms('tr', 14, 2 / 15))}, x AS (SELECT b.*, a.out AS a, {full(f'avg(tr) OVER {w(14)}', 14)} AS m FROM b JOIN a USING (symbol, rn)),
    k AS (SELECT *, CASE WHEN a < 0.8 * m THEN 'low' WHEN a > 1.3 * m THEN 'high' ELSE 'normal' END AS k FROM x)
    SELECT symbol, ts, k AS vol_regime, {r6("a * CASE k WHEN 'low' THEN 1.2 WHEN 'high' THEN 3 ELSE 2 END", 'vol_threshold')} FROM k""")
SIGNALS = "stack(3, 'body', close - open, 1D, 'range', high - low, 0.5D, 'level', close, 0.25D) AS (kind, value, weight)"
QUERIES["signal_confluence"] = lambda s, d: tidy(st.signal_confluence(bars(s, d).selectExpr("symbol", "tf", "ts", SIGNALS)), ["symbol", "ts", "kind"], ["confluence_score"], 9)
KINDS = {"body": 1.0, "level": 0.25, "range": 0.5}
ORACLE_SQL["signal_confluence"] = f"""WITH {bars_cte()}, s AS (SELECT symbol, ts, unnest(['body', 'level', 'range']) AS kind, unnest([close - open, close, high - low]) AS v, unnest([1.0, 0.25, 0.5]::DOUBLE[]) AS wt FROM b),
    f AS (SELECT *, sum(v * wt) OVER five AS sv, sum(wt) OVER five AS sw FROM s WINDOW five AS (PARTITION BY symbol, kind ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, {', '.join(f"last_value(CASE WHEN kind = '{k}' THEN {c} END IGNORE NULLS) OVER every AS {c}_{k}" for k in KINDS for c in ('sv', 'sw'))} FROM f WINDOW every AS (PARTITION BY symbol ORDER BY ts, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, kind, {r6('(' + ' + '.join(f'coalesce(sv_{k}, 0)' for k in KINDS) + ') / (' + ' + '.join(f'coalesce(sw_{k}, 0)' for k in KINDS) + ')', 'confluence_score', 9)} FROM k"""


def _breaker(b: DataFrame) -> DataFrame:
    return zn.zone_status(zn.breaker(pat.order_block(roll.atr_classic(b))), "bf", "bf_bottom", "bf_top")


HIT = lambda k: f"coalesce(low <= lag(bt, {k}) OVER ({S}) AND high >= lag(bb, {k}) OVER ({S}), false)"
on_bars("breaker_zones", _breaker, ["bf", "bf_bottom", "bf_top", "bf_alive", "bf_filled", "bf_expired", "bf_age", "bf_score"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT *, {ATR14} AS a, CASE WHEN close > max(high) OVER {P5} THEN 1 WHEN close < min(low) OVER {P5} THEN -1 ELSE 0 END AS k,
        {LASTO('close < open', 'low')} AS dl, {LASTO('close < open', 'high')} AS dh, {LASTO('close > open', 'low')} AS ul, {LASTO('close > open', 'high')} AS uh FROM t),
    z AS (SELECT *, lag(CASE k WHEN 1 THEN dl WHEN -1 THEN ul END) OVER ({S}) AS ob, lag(CASE k WHEN 1 THEN dh WHEN -1 THEN uh END) OVER ({S}) AS ot FROM x),
    y AS (SELECT *, CASE WHEN close > min(ot) OVER {P5} THEN 1 WHEN close < max(ob) OVER {P5} THEN -1 ELSE 0 END AS f FROM z),
    q AS (SELECT *, CASE WHEN f <> 0 THEN least(open, close) END AS bb, CASE WHEN f <> 0 THEN greatest(open, close) END AS bt FROM y),
    h AS (SELECT *, lag(f) OVER ({S}) AS bf, {HIT(1)} OR {HIT(2)} OR {HIT(3)} AS hit, lag(bt, 3) OVER ({S}) IS NOT NULL AS old, CASE WHEN lag(bt, 1) OVER ({S}) IS NOT NULL THEN 1 WHEN lag(bt, 2) OVER ({S}) IS NOT NULL THEN 2 WHEN lag(bt, 3) OVER ({S}) IS NOT NULL THEN 3 END AS age,
        coalesce(lag(bt, 1) OVER ({S}) - lag(bb, 1) OVER ({S}), lag(bt, 2) OVER ({S}) - lag(bb, 2) OVER ({S}), lag(bt, 3) OVER ({S}) - lag(bb, 3) OVER ({S})) AS tall FROM q),
    v AS (SELECT *, NOT hit AND age IS NOT NULL AS alive FROM h)
    SELECT symbol, ts, CAST(coalesce(bf, 0) AS INTEGER) AS bf, {r6('bb', 'bf_bottom')}, {r6('bt', 'bf_top')}, CAST(alive AS INTEGER) AS bf_alive, CAST(hit AS INTEGER) AS bf_filled, CAST(old AND NOT hit AS INTEGER) AS bf_expired,
        CAST(CASE WHEN alive THEN age END AS INTEGER) AS bf_age, {r6('CASE WHEN alive THEN 0.5 * coalesce(tall / nullif(a, 0), 0) + 0.3 / (1 + age) ELSE 0 END', 'bf_score')} FROM v""")


def _fusion(b: DataFrame) -> DataFrame:
    b = pat.supply_demand(pat.liquidity_sweep(pat.fair_value_gap(_breaker(b))))
    kinds = {"fvg": "fvg", "sd": "sd", "ob": "ob", "bf": "bf", "ls": "sweep"}
    for name, zone in kinds.items():
        if name != "bf":
            b = zn.zone_status(b, name, f"{zone}_bottom", f"{zone}_top")
    return zn.fusion(b, list(kinds))


def status_sql(n: str) -> str:
    """CTE s_{n}: the status of the zones with bottom {n}_b and top {n}_t in ``zones``."""
    back = lambda c, k: f"lag({n}_{c}, {k}) OVER ({S})"
    there = lambda k: f"{back('t', k)} IS NOT NULL AND {back('b', k)} IS NOT NULL"
    hits = " OR ".join(f"coalesce(low <= {back('t', k)} AND high >= {back('b', k)}, false)" for k in (1, 2, 3))
    pick = lambda c: "CASE " + " ".join(f"WHEN {there(k)} THEN {back(c, k)}" for k in (1, 2, 3)) + " END"
    return f"""h_{n} AS (SELECT symbol, ts, rn, a, {hits} AS hit, CASE {' '.join(f'WHEN {there(k)} THEN {k}' for k in (1, 2, 3))} END AS age, {there(3)} AS old, {pick('t')} AS tp, {pick('b')} AS bt FROM zones),
    s_{n} AS (SELECT *, NOT hit AND age IS NOT NULL AS alive, old AND NOT hit AS expired, CASE WHEN NOT hit AND age IS NOT NULL THEN 0.5 * coalesce(abs(tp - bt) / nullif(a, 0), 0) + 0.3 / (1 + age) ELSE 0 END AS score FROM h_{n})"""


ZONE_KINDS = ("fvg", "sd", "ob", "bf", "ls")
ZONES_SQL = f"""{bars_cte()}, zt AS (SELECT *, {TR} AS tr, row_number() OVER ({S}) AS rn, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2, max(high) OVER {P5} AS hi, min(low) OVER {P5} AS lo,
        {LASTO('close < open', 'low')} AS dl, {LASTO('close < open', 'high')} AS dh, {LASTO('close > open', 'low')} AS ul, {LASTO('close > open', 'high')} AS uh, min(low) OVER {P3} AS b3, max(high) OVER {P3} AS t3 FROM b),
    za AS (SELECT *, {ATR14} AS a FROM zt), zq AS (SELECT *, CAST(coalesce((high - low) / nullif(a, 0) <= 0.6, false) AS INTEGER) AS q FROM za),
    zk AS (SELECT *, CASE WHEN h2 < low THEN 1 WHEN l2 > high THEN -1 ELSE 0 END AS fk, CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END AS ok,
        coalesce((high - low) / nullif(a, 0) >= 1.2 AND abs(close - open) / nullif(high - low, 0) >= 0.55 AND sum(q) OVER {P3} = 3 AND close <> open, false) AS sk,
        CASE WHEN high > hi AND close < hi AND (high - greatest(open, close)) / nullif(a, 0) >= 0.5 THEN -1 WHEN low < lo AND close > lo AND (least(open, close) - low) / nullif(a, 0) >= 0.5 THEN 1 ELSE 0 END AS lk FROM zq),
    zo AS (SELECT *, lag(CASE ok WHEN 1 THEN dl WHEN -1 THEN ul END) OVER ({S}) AS ob_b, lag(CASE ok WHEN 1 THEN dh WHEN -1 THEN uh END) OVER ({S}) AS ob_t,
        lag(CASE fk WHEN 1 THEN h2 WHEN -1 THEN high END) OVER ({S}) AS fvg_b, lag(CASE fk WHEN 1 THEN low WHEN -1 THEN l2 END) OVER ({S}) AS fvg_t,
        CASE WHEN sk THEN b3 END AS sd_b, CASE WHEN sk THEN t3 END AS sd_t, CASE lk WHEN -1 THEN high WHEN 1 THEN lo END AS ls_t, CASE lk WHEN -1 THEN hi WHEN 1 THEN low END AS ls_b FROM zk),
    zb AS (SELECT *, CASE WHEN close > min(ob_t) OVER {P5} THEN 1 WHEN close < max(ob_b) OVER {P5} THEN -1 ELSE 0 END AS bk FROM zo),
    zones AS (SELECT *, CASE WHEN bk <> 0 THEN least(open, close) END AS bf_b, CASE WHEN bk <> 0 THEN greatest(open, close) END AS bf_t FROM zb), {', '.join(map(status_sql, ZONE_KINDS))}"""
STATUS = [f"{n}_{c}" for n in ZONE_KINDS for c in ("alive", "filled", "expired", "age", "score")]
on_bars("zone_status", _fusion, STATUS, f"""
    WITH {ZONES_SQL} SELECT symbol, ts, {', '.join(f"CAST(s_{n}.alive AS INTEGER) AS {n}_alive, CAST(s_{n}.hit AS INTEGER) AS {n}_filled, CAST(s_{n}.expired AS INTEGER) AS {n}_expired, CAST(CASE WHEN s_{n}.alive THEN s_{n}.age END AS INTEGER) AS {n}_age, {r6(f's_{n}.score', f'{n}_score')}" for n in ZONE_KINDS)}
    FROM s_fvg {' '.join(f'JOIN s_{n} USING (symbol, ts)' for n in ZONE_KINDS[1:])}""")
on_bars("sr_fusion", lambda b: _fusion(b).fillna("", ["sr_source"]), ["sr_score_raw", "sr_on", "sr_score", "sr_source"], f"""
    WITH RECURSIVE {ZONES_SQL}, {', '.join(recurrence(f'e_{n}', f's_{n}', *ema_terms('score', 5)) for n in ZONE_KINDS)},
    {', '.join(f"w_{n} AS (SELECT s.symbol, s.ts, s.alive, CASE WHEN s.alive THEN s.age END AS age, CASE WHEN s.alive AND max(CAST(s.hit OR s.expired AS INTEGER)) OVER (PARTITION BY s.symbol ORDER BY s.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 0 THEN e.out / (1 + s.age / 5.0) ELSE 0 END AS v FROM s_{n} s JOIN e_{n} e USING (symbol, rn))" for n in ZONE_KINDS)},
    r AS (SELECT symbol, ts, greatest({', '.join(f'w_{n}.v' for n in ZONE_KINDS)}, 0) AS raw, [{', '.join(f"{{'v': w_{n}.v, 'idle': 1 - CAST(w_{n}.alive AS INTEGER), 'age': coalesce(w_{n}.age, 0), 'k': {k}, 'name': '{n}'}}" for k, n in enumerate(ZONE_KINDS))}] AS every FROM w_fvg {' '.join(f'JOIN w_{n} USING (symbol, ts)' for n in ZONE_KINDS[1:])}),
    o AS (SELECT *, coalesce({LAST('CASE WHEN raw >= 0.55 THEN 1 WHEN raw < 0.35 THEN 0 END', ALLW)}, 0) AS sr_on, (SELECT arg_min(z.name, (z.idle, z.age, z.k)) FROM (SELECT unnest(every) AS z) WHERE raw - z.v <= 0.02) AS best FROM r)
    SELECT symbol, ts, {r6('raw', 'sr_score_raw')}, CAST(sr_on AS INTEGER) AS sr_on, {r6('CASE WHEN sr_on = 1 THEN raw ELSE 0 END', 'sr_score')}, CASE WHEN sr_on = 1 THEN best ELSE '' END AS sr_source FROM o""")
on_bars("causal_swings", lambda b: st.causal_swings(b, 0.2), ["cs", "cs_price", "cs_age"], f"""
    WITH RECURSIVE {bars_cte()}, n AS (SELECT symbol, ts, high, low, close, row_number() OVER ({S}) - 1 AS i, first_value(high) OVER ({S}) AS h0, first_value(low) OVER ({S}) AS l0, first_value(close) OVER ({S}) AS c0 FROM b),
    m AS (SELECT symbol, i, ts, 0 AS seek, CAST(0 AS DOUBLE) AS ext, CAST(0 AS BIGINT) AS at, CAST(0 AS BIGINT) AS last, 0 AS f, CAST(NULL AS DOUBLE) AS fp, CAST(NULL AS BIGINT) AS age FROM n WHERE i = 0
        UNION ALL SELECT symbol, i, ts, CASE WHEN seek = 0 THEN way WHEN turn THEN -seek ELSE seek END, CASE WHEN seek = 0 THEN CASE way WHEN 1 THEN greatest(high, h0) WHEN -1 THEN least(low, l0) ELSE 0 END WHEN turn THEN CASE seek WHEN 1 THEN low ELSE high END ELSE e1 END,
            CASE WHEN seek = 0 THEN CASE WHEN way = 1 AND high >= h0 OR way = -1 AND low <= l0 THEN i ELSE 0 END WHEN turn THEN i ELSE at1 END, CASE WHEN seek = 0 THEN 0 WHEN turn THEN at1 ELSE last END,
            CASE WHEN seek = 0 THEN -way WHEN turn THEN seek ELSE 0 END, CASE WHEN seek = 0 THEN CASE way WHEN 1 THEN l0 WHEN -1 THEN h0 END WHEN turn THEN e1 END, CASE WHEN seek = 0 THEN CASE WHEN way <> 0 THEN i END WHEN turn THEN i - at1 END
        FROM (SELECT *, seek <> 0 AND NOT (seek * (e1 - CASE seek WHEN 1 THEN low ELSE high END) / greatest(abs(e1), 1e-12) < 0.2 OR at1 - last < 1) AS turn
            FROM (SELECT n.*, m.seek, m.last, CASE WHEN n.high > n.h0 OR n.close > n.c0 THEN 1 WHEN n.low < n.l0 OR n.close < n.c0 THEN -1 ELSE 0 END AS way, CASE m.seek WHEN 1 THEN greatest(n.high, m.ext) ELSE least(n.low, m.ext) END AS e1,
                CASE WHEN m.seek = 1 AND n.high >= m.ext OR m.seek = -1 AND n.low <= m.ext THEN n.i ELSE m.at END AS at1 FROM m JOIN n ON n.symbol = m.symbol AND n.i = m.i + 1)))
    SELECT symbol, ts, {r6('f', 'cs')}, {r6('fp', 'cs_price')}, {r6('age', 'cs_age')} FROM m""")


def pool_sql(side: int, swing: str, n: str) -> tuple[str, str]:
    """Columns of the pools' state machine for one side: those of the start, and those of a step."""
    reach = "n.high" if side == 1 else "n.low"
    beyond = "<" if side == 1 else ">"
    at = f"list_position(list_transform(m.p{n}, lambda p: abs(n.{swing} - p) / p <= 0.05), true)"
    founds = f"n.{swing} IS NOT NULL AND coalesce({at}, 0) = 0"
    p1, a1 = f"CASE WHEN {founds} THEN list_append(m.p{n}, n.{swing}) ELSE m.p{n} END", f"CASE WHEN {founds} THEN list_append(m.a{n}, true) ELSE m.a{n} END"
    t1 = f"CASE WHEN n.{swing} IS NULL THEN m.t{n} WHEN coalesce({at}, 0) = 0 THEN list_append(m.t{n}, 1) ELSE list_transform(m.t{n}, lambda t, i: CASE WHEN i = {at} THEN t + 1 ELSE t END) END"
    start = f"CAST([] AS DOUBLE[]) AS p{n}, CAST([] AS INTEGER[]) AS t{n}, CAST([] AS BOOLEAN[]) AS a{n}, CAST(NULL AS INTEGER) AS j{n}, CAST(0 AS BIGINT) AS s{n}"
    hit = lambda i: f"(({p1})[{i}] {beyond} {reach})"
    step = f"{p1}, {t1}, list_transform({a1}, lambda a, i: a AND NOT {hit('i')}), CASE WHEN n.{swing} IS NOT NULL THEN ({t1})[coalesce(nullif({at}, 0), len({t1}))] END, CAST(len(list_filter(list_transform({a1}, lambda a, i: a AND {hit('i')}), lambda x: x)) AS BIGINT)"
    return start, step


_high, _low = pool_sql(1, "sh", "h"), pool_sql(-1, "sl", "l")
on_bars("liquidity_pools", lambda b: st.liquidity_pools(st.swings(b, 3, 3), 0.05), ["pool_high_touches", "pool_low_touches", "swept_highs", "swept_lows"], f"""
    WITH RECURSIVE {SWINGS_SQL}, n AS (SELECT symbol, ts, high, low, sh, sl, row_number() OVER ({S}) AS i FROM sw),
    m AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, {_high[0]}, {_low[0]} FROM n UNION ALL SELECT n.symbol, n.i, n.ts, {_high[1]}, {_low[1]} FROM m JOIN n ON n.symbol = m.symbol AND n.i = m.i + 1)
    SELECT symbol, ts, {r6('jh', 'pool_high_touches')}, {r6('jl', 'pool_low_touches')}, {r6('sh', 'swept_highs')}, {r6('sl', 'swept_lows')} FROM m WHERE i > 0""")

# -- patterns of swings, zones to trade, observed costs and acceptance -------------------------


def _swing_rows(s: SparkSession, d: str) -> DataFrame:
    b = st.swings(bars(s, d), 3, 3)
    return b.withColumns({"sw": F.when(F.col("swing_high").isNotNull(), 1).when(F.col("swing_low").isNotNull(), -1).otherwise(0), "sw_price": F.coalesce("swing_high", "swing_low")})


def _legs(s: SparkSession, d: str) -> DataFrame:
    return lv.legs(_swing_rows(s, d), "sw", "sw_price")


POINTS_SQL = f"""{SWINGS_SQL}, pts AS (SELECT symbol, ts, coalesce(sh, sl) AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM sw WHERE sh IS NOT NULL OR sl IS NOT NULL),
    abc AS (SELECT symbol, max(p) FILTER (d = 4) AS a, max(p) FILTER (d = 3) AS b, max(p) FILTER (d = 2) AS c, max(p) FILTER (d = 1) AS e FROM pts GROUP BY symbol HAVING count(*) >= 4)"""
QUERIES["swing_legs"] = lambda s, d: tidy(lv.select_legs(_legs(s, d), 5, 1.0, 0.1, 40), ["symbol", "nth"], ["start_ts", "end_ts", "start_price", "end_price"])
ORACLE_SQL["swing_legs"] = f"""WITH {POINTS_SQL}, l AS (SELECT symbol, d, lead(ts) OVER (PARTITION BY symbol ORDER BY d) AS start_ts, ts AS end_ts, lead(p) OVER (PARTITION BY symbol ORDER BY d) AS sp, p AS ep FROM pts),
    f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS nth FROM l WHERE start_ts IS NOT NULL AND abs(ep - sp) >= 1 AND abs(ep - sp) >= 0.1 * greatest(least(sp, ep), 1e-9) AND d - 1 <= 40)
    SELECT symbol, CAST(nth AS INTEGER) AS nth, start_ts, end_ts, {r6('sp', 'start_price')}, {r6('ep', 'end_price')} FROM f WHERE nth <= 5"""
QUERIES["equal_legs"] = lambda s, d: tidy(lv.equal_legs(lv.swing_points(_legs(s, d)), 0.2), ["symbol"], ["length_ab", "cd_ratio", "abcd_error", "abcd"])
ORACLE_SQL["equal_legs"] = f"WITH {POINTS_SQL}, x AS (SELECT symbol, abs(b - a) AS l, abs(e - c) / nullif(abs(b - a), 0) AS r FROM abc) SELECT symbol, {r6('l', 'length_ab')}, {r6('r', 'cd_ratio')}, {r6('abs(r - 1)', 'abcd_error')}, CAST(coalesce(abs(r - 1) <= 0.2, false) AS INTEGER) AS abcd FROM x"
QUERIES["swing_projections"] = lambda s, d: tidy(lv.projections(lv.swing_points(_legs(s, d)), (1.0, 1.272, 1.618), 5.0), ["symbol", "ratio"], ["d_expected", "d_error"])
ORACLE_SQL["swing_projections"] = f"""WITH {POINTS_SQL}, x AS (SELECT *, unnest([1.0, 1.272, 1.618]::DOUBLE[]) AS ratio FROM abc), y AS (SELECT *, c + ratio * (b - a) AS de FROM x), z AS (SELECT *, abs(e - de) / nullif(abs(b - a), 0) AS er FROM y)
    SELECT symbol, ratio, {r6('de', 'd_expected')}, {r6('er', 'd_error')} FROM z WHERE er IS NULL OR er <= 5"""
WEIGHED = ([10.0, 10.2, 20.0, 35.0, 50.0, 75.0, 75.5, 100.0], [1.0, 0.5, 0.8, 0.7, 1.0, 0.6, 0.9, 0.4])
on_bars("sr_weighted_overlap", lambda b: lv.weighted_overlap(b, *WEIGHED), ["sr_weighted"], f"""
    WITH {bars_cte()}, v AS (SELECT unnest({WEIGHED[0]}::DOUBLE[]) AS v, unnest({WEIGHED[1]}::DOUBLE[]) AS wt), x AS (SELECT symbol, ts, abs(close - v) AS far, abs(close) * 0.05 AS reach, wt, row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(close - v), v) AS nth FROM b, v),
    s AS (SELECT symbol, ts, sum(CASE WHEN far > reach THEN 0 WHEN nth = 1 THEN wt / (1 + exp(-12 * (0.5 - far / nullif(reach, 0)))) ELSE (1 - far / nullif(reach, 0)) * wt END) AS s FROM x GROUP BY ALL)
    SELECT symbol, ts, {r6('least(1.0, greatest(0.0, coalesce(s, 0)))', 'sr_weighted')} FROM s""")
ZONES = ["zone_mid", "distance", "near", "long_stop", "long_target", "long_rr", "short_stop", "short_target", "short_rr"]
QUERIES["trade_zones"] = lambda s, d: tidy(lv.trade_zones(roll.atr_classic(bars(s, d)).selectExpr("symbol", "least(open, close) zone_low", "greatest(open, close) zone_high", "CAST(volume AS DOUBLE) score", "50D price", "atr"), ["symbol"]), ["symbol", "rank"], ZONES)
ORACLE_SQL["trade_zones"] = f"""WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), z AS (SELECT symbol, least(open, close) AS lo, greatest(open, close) AS hi, volume AS score, {ATR14} AS a FROM t),
    x AS (SELECT *, CASE WHEN a > 0 THEN a ELSE avg(hi - lo) OVER (PARTITION BY symbol) END AS r, abs((lo + hi) / 2 - 50) AS dist FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, dist, lo, hi) AS k FROM x)
    SELECT symbol, CAST(k AS INTEGER) AS rank, {r6('(lo + hi) / 2', 'zone_mid')}, {r6('dist', 'distance')}, CAST(50 >= lo - 0.15 AND 50 <= hi + 0.15 AS INTEGER) AS near, {r6('lo - 1.5 * r', 'long_stop')}, {r6('hi + 2 * r', 'long_target')}, {r6('(hi + 2 * r - 50) / nullif(50 - lo + 1.5 * r, 0)', 'long_rr')},
    {r6('hi + 1.5 * r', 'short_stop')}, {r6('lo - 2 * r', 'short_target')}, {r6('(50 - lo + 2 * r) / nullif(hi + 1.5 * r - 50, 0)', 'short_rr')} FROM k WHERE k <= 5"""
on_bars("band_position", lambda b: roll.band_position(b.withColumns({"hi": roll.highest("high", 20), "lo": roll.lowest("low", 20)}), "lo", "hi"), ["position"], f"""
    WITH {bars_cte()}, x AS (SELECT *, {full(f'max(high) OVER {w(20)}', 20)} AS hi, {full(f'min(low) OVER {w(20)}', 20)} AS lo FROM b) SELECT symbol, ts, {r6('(close - lo) / nullif(hi - lo, 0)', 'position')} FROM x""")
on_bars("oscillator_zones", lambda b: roll.oscillator_zones(roll.mfi(b), "mfi"), ["mfi_overbought", "mfi_oversold", "mfi_mid"], f"""
    WITH {bars_cte()}, x AS (SELECT *, (high + low + close) / 3 AS tp FROM b), y AS (SELECT *, tp - lag(tp) OVER ({S}) AS d FROM x), z AS (SELECT *, CASE WHEN d > 0 THEN tp * volume WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN tp * volume WHEN d IS NOT NULL THEN 0 END AS dn FROM y),
    m AS (SELECT symbol, ts, CASE WHEN count(up) OVER {w(14)} >= 14 THEN CASE WHEN sum(up) OVER {w(14)} + sum(dn) OVER {w(14)} = 0 THEN 50 ELSE 100 * sum(up) OVER {w(14)} / (sum(up) OVER {w(14)} + sum(dn) OVER {w(14)}) END END AS m FROM z)
    SELECT symbol, ts, CAST(coalesce(m >= 70, false) AS INTEGER) AS mfi_overbought, CAST(coalesce(m <= 30, false) AS INTEGER) AS mfi_oversold, CAST(coalesce(abs(m - 50) <= 5, false) AS INTEGER) AS mfi_mid FROM m""")
on_bars("ma_slope_regression", lambda b: roll.ma_slope_regression(roll.atr_classic(b)), ["ma_reg_slope"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr, row_number() OVER ({S}) AS rn FROM b), x AS (SELECT *, {ATR14} AS a, {full(f'avg(close) OVER {w(20)}', 20)} AS m FROM t)
    SELECT symbol, ts, {r6('(' + full(f'regr_slope(m, rn) OVER {w(10)}', 10, 'm') + ') / nullif(a, 0)', 'ma_reg_slope')} FROM x""")
QUERIES["observed_slippage"] = lambda s, d: tidy(acc.observed_slippage(s.read.parquet(f"{d}/events.parquet").filter("value IS NOT NULL").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END side", "value - 0.5 bid", "value + 0.5 ask", "value + (event_id % 7 - 3) / 4D fill_price"), 0.2), ["event_id"], ["market_price", "slippage", "cap_exceeded"])
ORACLE_SQL["observed_slippage"] = f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, value AS v, value + (event_id % 7 - 3) / 4 AS f FROM events WHERE value IS NOT NULL), y AS (SELECT *, v + side * 0.5 AS m, greatest(0.0, side * (f - (v + side * 0.5))) AS slip FROM x)
    SELECT event_id, {r6('m', 'market_price')}, {r6('slip', 'slippage')}, CAST(slip > 0.2 AS INTEGER) AS cap_exceeded FROM y"""


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id trade_id", "event_type symbol", "value lots")
    return tidy(acc.round_trip(trades.withColumn("total_cost", F.expr("lots * 0.5D")), trades.withColumn("total_cost", F.expr("lots * 0.25D + 1"))), ["trade_id"], ["entry_cost", "exit_cost", "round_trip_cost"])


QUERIES["round_trip_costs"] = _round_trip
ORACLE_SQL["round_trip_costs"] = f"SELECT event_id AS trade_id, {r6('value * 0.5', 'entry_cost')}, {r6('value * 0.25 + 1', 'exit_cost')}, {r6('value * 0.75 + 1', 'round_trip_cost')} FROM events"
QUERIES["acceptance_gates"] = lambda s, d: acc.acceptance(acc.report(bars(s, d).withColumn("pnl", F.col("close") - F.col("open")), ("symbol",), ["ts"]), {"trades": 30, "win_rate": 0.25, "sharpe": 0.0}, {"max_drawdown": 0.95}).select("symbol", "failed_gates", "accepted")
ORACLE_SQL["acceptance_gates"] = f"""WITH {bars_cte()}, t AS (SELECT *, close - open AS pnl, sum(close - open) OVER {ALLW} AS eq FROM b), p AS (SELECT *, max(eq) OVER {ALLW} AS peak FROM t),
    g AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS wr, avg(pnl) AS m, max(peak - eq) / greatest(1.0, abs(max(peak))) AS dd FROM p GROUP BY symbol),
    f AS (SELECT symbol, concat_ws(',', CASE WHEN n < 30 THEN 'trades' END, CASE WHEN wr < 0.25 THEN 'win_rate' END, CASE WHEN m < 0 THEN 'sharpe' END, CASE WHEN dd > 0.95 THEN 'max_drawdown' END) AS failed_gates FROM g)
    SELECT symbol, failed_gates, CAST(failed_gates = '' AS INTEGER) AS accepted FROM f"""

# -- zigzag by depth, its legs and levels ------------------------------------------------------


def depth_sql(name: str, source: str, depth: int = 6, deviation: float = 5.0, backstep: int = 3) -> str:
    """CTEs: {name}_p, the swings of ``source`` as the state machine over its candidates gives them, and {name}_l, the legs."""
    over, ahead = f"({S} ROWS BETWEEN {depth - 1} PRECEDING AND CURRENT ROW)", f"({S} ROWS BETWEEN 1 FOLLOWING AND {backstep} FOLLOWING)"
    return f"""{name}_w AS (SELECT *, CASE WHEN count(*) OVER {over} = {depth} THEN min(low) OVER {over} END AS lo, CASE WHEN count(*) OVER {over} = {depth} THEN max(high) OVER {over} END AS hi FROM {source}),
    {name}_e AS (SELECT *, min(CASE WHEN low - lo <= {deviation} THEN lo END) OVER {ahead} AS under, max(CASE WHEN hi - high <= {deviation} THEN hi END) OVER {ahead} AS beyond FROM {name}_w),
    {name}_c AS (SELECT *, CASE WHEN low = lo AND NOT coalesce(under < low, false) THEN low END AS l, CASE WHEN high = hi AND NOT coalesce(beyond > high, false) THEN high END AS h FROM {name}_e),
    {name}_v AS (SELECT symbol, ts, l, h, row_number() OVER ({S}) AS n FROM {name}_c WHERE l IS NOT NULL OR h IS NOT NULL),
    {name}_m AS (SELECT symbol, n, ts, CASE WHEN h IS NOT NULL THEN 1 ELSE -1 END AS kind, CASE WHEN h IS NOT NULL THEN h ELSE l END AS price, 1 AS run, ts AS began FROM {name}_v WHERE n = 1
        UNION ALL SELECT v.symbol, v.n, v.ts, k.kind, CASE WHEN k.kind = 1 THEN v.h ELSE v.l END, m.run + CAST(k.kind <> m.kind AS INTEGER), CASE WHEN k.kind <> m.kind THEN v.ts ELSE m.began END
        FROM {name}_m m JOIN {name}_v v ON v.symbol = m.symbol AND v.n = m.n + 1, LATERAL (SELECT CASE WHEN v.l IS NOT NULL AND v.h IS NOT NULL THEN -m.kind WHEN v.h IS NOT NULL THEN 1 ELSE -1 END AS kind) k),
    {name}_r AS (SELECT symbol, run, any_value(kind) AS kind, arg_min(ts, (-kind * price, ts)) AS ts, arg_min(price, (-kind * price, ts)) AS price, any_value(began) AS began FROM {name}_m GROUP BY symbol, run),
    {name}_p AS (SELECT *, lead(began) OVER (PARTITION BY symbol ORDER BY run) AS stands FROM {name}_r),
    {name}_d AS (SELECT symbol, ts AS a, lead(ts) OVER ({S}) AS z, price AS ap, lead(price) OVER ({S}) AS zp, lead(kind) OVER ({S}) AS zk, lead(stands) OVER ({S}) AS zs FROM {name}_p),
    {name}_g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY a) AS leg FROM (SELECT *, coalesce(sign(zp - ap) = lag(sign(zp - ap)) OVER (PARTITION BY symbol ORDER BY a), false) AS same FROM {name}_d WHERE z IS NOT NULL)),
    {name}_l AS (SELECT symbol, min(a) AS start_ts, max(z) AS end_ts, CASE WHEN count(*) = 1 THEN max(zk) ELSE max(CAST(sign(zp - ap) AS INTEGER)) END AS direction, arg_min(ap, a) AS start_price, arg_max(zp, a) AS end_price, arg_max(zs, a) AS confirmed FROM {name}_g GROUP BY symbol, leg)"""


def _depth(b: DataFrame) -> DataFrame:
    return zz.depth_swings(b, 6, 5.0, 3)


on_bars("zigzag_depth", _depth, ["zz_state", "zz_price", "zz_confirmed", "zz_leg"], f"""
    WITH RECURSIVE {bars_cte()}, {depth_sql('q', 'b')}, before AS (SELECT b.symbol, b.ts, max(m.n) AS n FROM b JOIN q_m m ON m.symbol = b.symbol AND m.ts < b.ts GROUP BY ALL)
    SELECT b.symbol, b.ts, CAST(coalesce(p.kind, 0) AS INTEGER) AS zz_state, {r6('p.price', 'zz_price')}, p.stands AS zz_confirmed, CAST(-coalesce(m.kind, 0) AS INTEGER) AS zz_leg
    FROM b LEFT JOIN q_p p ON p.symbol = b.symbol AND p.ts = b.ts LEFT JOIN before ON before.symbol = b.symbol AND before.ts = b.ts LEFT JOIN q_m m ON m.symbol = b.symbol AND m.n = before.n""")
LEG = ["end_ts", "direction", "start_price", "end_price", "confirmed"]
QUERIES["zigzag_legs"] = lambda s, d: tidy(zz.depth_legs(_depth(bars(s, d))), ["symbol", "start_ts"], LEG)
ORACLE_SQL["zigzag_legs"] = f"WITH RECURSIVE {bars_cte()}, {depth_sql('q', 'b')} SELECT symbol, start_ts, end_ts, CAST(direction AS INTEGER) AS direction, {r6('start_price', 'start_price')}, {r6('end_price', 'end_price')}, confirmed FROM q_l"
QUERIES["fibonacci_depth_levels"] = lambda s, d: tidy(lv.fibonacci(zz.newest_legs(zz.depth_legs(_depth(bars(s, d))), 4, True)), ["symbol", "nth"], ["start_ts", "end_ts", "direction", "ratio", "level"])
ORACLE_SQL["fibonacci_depth_levels"] = f"""WITH RECURSIVE {bars_cte()}, {depth_sql('q', 'b')}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY end_ts DESC) AS nth FROM q_l WHERE confirmed IS NOT NULL)
    SELECT symbol, CAST(nth AS INTEGER) AS nth, start_ts, end_ts, CAST(direction AS INTEGER) AS direction, ratio, {r6('end_price - ratio * (end_price - start_price)', 'level')} FROM n, {RATIOS} WHERE nth <= 4"""


def along_sql(shift: int = 0, extend: bool = False) -> str:
    """CTE along: bars with the boundaries of the legs q_l that fall before the next bar; the newest says what holds."""
    keep = "direction" if extend else "0"
    level = lambda test: f"CASE WHEN {test} THEN end_price END" if extend else "NULL"
    at = f"+ INTERVAL {shift} MINUTE"
    return f"""u AS (SELECT symbol, start_ts {at} AS t, 2 AS o, direction AS dir, -direction AS mark, CASE WHEN direction > 0 THEN start_price END AS sup, CASE WHEN direction <= 0 THEN start_price END AS res FROM q_l
        UNION ALL SELECT symbol, end_ts {at}, 1, {keep}, direction, {level('direction < 0')}, {level('direction >= 0')} FROM q_l),
    nx AS (SELECT *, coalesce(lead(ts) OVER ({S}), TIMESTAMP '9999-12-31') AS nxt FROM b),
    along AS (SELECT nx.*, x.t, x.dir, x.mark, x.sup, x.res FROM nx LEFT JOIN LATERAL (SELECT * FROM u WHERE u.symbol = nx.symbol AND u.t < nx.nxt ORDER BY u.t DESC, u.o DESC LIMIT 1) x ON true)"""


QUERIES["zigzag_higher"] = lambda s, d: tidy(zz.along_legs(bars(s, d), zz.depth_legs(zz.depth_swings(src.resample(bars(s, d), "H4"), 4, 5.0, 2))), ["symbol", "ts"], ["leg_dir", "leg_mark"])
ORACLE_SQL["zigzag_higher"] = f"""WITH RECURSIVE {bars_cte()}, {H4}, {depth_sql('q', 'h4', 4, 5.0, 2)}, {along_sql()}
    SELECT symbol, ts, CAST(coalesce(dir, 0) AS INTEGER) AS leg_dir, CAST(CASE WHEN t >= ts THEN mark ELSE 0 END AS INTEGER) AS leg_mark FROM along"""
QUERIES["zigzag_levels"] = lambda s, d: tidy(zz.level_distance(zz.along_legs(roll.atr_classic(bars(s, d)), zz.depth_legs(zz.depth_swings(bars(s, d, "H4"), 4, 5.0, 2)), "INTERVAL 180 MINUTE", True)), ["symbol", "ts"], ["sr_support", "sr_resistance", "dist_to_support_norm", "dist_to_resistance_norm"])
ORACLE_SQL["zigzag_levels"] = f"""WITH RECURSIVE {bars_cte()}, {H4}, {depth_sql('q', 'h4', 4, 5.0, 2)}, {along_sql(180, True)}, tr AS (SELECT symbol, ts, close, {TR} AS tr FROM b), a AS (SELECT symbol, ts, {ATR14} AS a FROM tr)
    SELECT symbol, ts, {r6('sup', 'sr_support')}, {r6('res', 'sr_resistance')}, {r6('(close - sup) / (a + 1e-8)', 'dist_to_support_norm')}, {r6('(res - close) / (a + 1e-8)', 'dist_to_resistance_norm')} FROM along JOIN a USING (symbol, ts)"""
on_bars("zigzag_state", lambda b: zz.swing_state(_depth(b)), ["pivot_age", "pivot_price", "pivot_distance"], f"""
    WITH RECURSIVE {bars_cte()}, {depth_sql('q', 'b')}, x AS (SELECT b.*, p.price, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS rn FROM b LEFT JOIN q_p p USING (symbol, ts)),
    y AS (SELECT *, last_value(price IGNORE NULLS) OVER {ALLW} AS lp, last_value(CASE WHEN price IS NOT NULL THEN rn END IGNORE NULLS) OVER {ALLW} AS seen FROM x)
    SELECT symbol, ts, CAST(coalesce(rn - seen, -1) AS INTEGER) AS pivot_age, {r6('coalesce(lp, 0)', 'pivot_price')}, {r6('coalesce(abs(close - lp), 0)', 'pivot_distance')} FROM y""")


def _regime_pro(s: SparkSession, d: str) -> DataFrame:
    legs = zz.depth_legs(zz.depth_swings(bars(s, d, "H4"), 4, 5.0, 2))
    marked = zz.along_legs(roll.atr_classic(bars(s, d)), legs).withColumns({"bos": F.signum(F.when(F.abs(F.col("close") - F.col("open")) > 40, F.col("close") - F.col("open"))).cast("int"), "choch": F.lit(0)})
    return tidy(zz.regime_with_legs(marked), ["symbol", "ts"], ["regime_pro"])


QUERIES["regime_with_legs"] = _regime_pro
ORACLE_SQL["regime_with_legs"] = f"""WITH RECURSIVE {bars_cte()}, {H4}, {depth_sql('q', 'h4', 4, 5.0, 2)}, {along_sql()}, tr AS (SELECT symbol, ts, close, {TR} AS tr FROM b), a AS (SELECT symbol, ts, {ATR14} AS a FROM tr),
    k AS (SELECT *, CASE WHEN a IS NOT NULL AND close - open > 40 OR dir = 1 THEN 1 WHEN a IS NOT NULL AND close - open < -40 OR dir = -1 THEN -1 END AS k FROM along JOIN a USING (symbol, ts))
    SELECT symbol, ts, CAST(coalesce(last_value(k IGNORE NULLS) OVER {ALLW}, 0) AS INTEGER) AS regime_pro FROM k"""

# -- what becomes of breaks, scores of baskets, clusters -----------------------------------------

OUTCOMES = ["retest_up", "retest_down", "fail_up", "fail_down"]
for _known, _late in ((True, 5), (False, 1)):
    _past = lambda n: f"({S} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    on_bars("break_outcomes" if _known else "break_outcomes_older", lambda b, k=_known: pat.break_outcomes(b, known=k), OUTCOMES, f"""
    WITH {bars_cte()}, x AS (SELECT *, CASE WHEN count(high) OVER {w(20)} >= 10 THEN max(high) OVER {w(20)} END AS hi0, CASE WHEN count(low) OVER {w(20)} >= 10 THEN min(low) OVER {w(20)} END AS lo0 FROM b),
    y AS (SELECT *, lag(hi0) OVER ({S}) AS hi, lag(lo0) OVER ({S}) AS lo, min(low) OVER {_past(5)} AS l5, max(high) OVER {_past(5)} AS h5, min(close) OVER {_past(3)} AS c3, max(close) OVER {_past(3)} AS d3 FROM x),
    f AS (SELECT *, close > hi AND l5 <= hi AS a, close < lo AND h5 >= lo AS b, close > hi AND c3 < hi AS c, close < lo AND d3 > lo AS d FROM y)
    SELECT symbol, ts, {', '.join(f'coalesce(lag(CAST(coalesce({x}, false) AS INTEGER), {_late}) OVER ({S}), 0) AS {n}' for x, n in zip('abcd', OUTCOMES, strict=True))} FROM f""")
DIV_PAST = "last_value(CASE WHEN p = {k} THEN {c} END IGNORE NULLS) OVER {over}"
for _hidden, _sign in ((False, 1), (True, -1)):
    on_bars("divergence_values_hidden" if _hidden else "divergence_values", lambda b, h=_hidden: roll.divergence_values(b.withColumn("osc", F.col("high") - F.col("low")), osc="osc", hidden=h), ["div_bear_value", "div_bull_value"], f"""
    WITH {bars_cte()}, x AS (SELECT *, high - low AS o, list(close) OVER {w(5)} AS l FROM b),
    y AS (SELECT *, CASE WHEN len(l) < 5 THEN 0 WHEN l[3] = list_max(l) AND l[4] < l[3] AND l[5] < l[3] THEN 1 WHEN l[3] = list_min(l) AND l[4] > l[3] AND l[5] > l[3] THEN -1 ELSE 0 END AS p FROM x),
    z AS (SELECT *, {DIV_PAST.format(k=1, c='close', over=PASTW)} AS hp, {DIV_PAST.format(k=1, c='o', over=PASTW)} AS ho, {DIV_PAST.format(k=-1, c='close', over=PASTW)} AS lp, {DIV_PAST.format(k=-1, c='o', over=PASTW)} AS lo FROM y)
    SELECT symbol, ts, {r6(f'CASE WHEN p = 1 AND sign(close - hp) = {_sign} AND sign(o - ho) = {-_sign} THEN o - ho END', 'div_bear_value')}, {r6(f'CASE WHEN p = -1 AND sign(close - lp) = {-_sign} AND sign(o - lo) = {_sign} THEN o - lo END', 'div_bull_value')} FROM z""")
on_bars("zscore_distance", lambda b: b.withColumn("z", roll.zscore_distance(F.col("close"), roll.mean("close", 20), F.stddev_pop("close").over(roll.frame(20)))), ["z"], f"""
    WITH {bars_cte()} SELECT symbol, ts, {r6(full(f'(close - avg(close) OVER {w(20)}) / (abs(stddev_pop(close) OVER {w(20)}) + 1e-12)', 20), 'z')} FROM b""")


def _confluence_score(b: DataFrame) -> DataFrame:
    b = pat.break_outcomes(pat.breakouts(pat.fair_value_gap(roll.atr_classic(b))))
    signals = {"fvg_near": conf.nearness(conf.zone_distance("fvg_bottom", "fvg_top")), "bos": F.col("break_up"), "choch": F.col("break_down"), "confluence": F.lit(0.5), "conflict": F.col("retest_up"), "fail_up": F.col("fail_up"), "spike": F.col("break_down")}
    return conf.score(b, signals, {"extras": 0.5}, strong=0.3, passes=0.15)


BASKET = [*(f"conf_{b}" for b in conf.BASKETS), "conf_score", "conf_strong", "conf_pass"]
on_bars("confluence_score", _confluence_score, BASKET, f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2 FROM b), g AS (SELECT *, {ATR14} AS a, CASE WHEN h2 < low THEN h2 WHEN l2 > high THEN high END AS bo, CASE WHEN h2 < low THEN low WHEN l2 > high THEN l2 END AS tp FROM t),
    z0 AS (SELECT *, lag(bo) OVER ({S}) AS fb, lag(tp) OVER ({S}) AS ft, CASE WHEN count(high) OVER {w(20)} >= 10 THEN max(high) OVER {w(20)} END AS hi0, CASE WHEN count(low) OVER {w(20)} >= 10 THEN min(low) OVER {w(20)} END AS lo0 FROM g),
    z AS (SELECT *, last_value(fb IGNORE NULLS) OVER {ALLW} AS lb, last_value(ft IGNORE NULLS) OVER {ALLW} AS lt, lag(hi0) OVER ({S}) AS hi, lag(lo0) OVER ({S}) AS lo, min(low) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS l5, min(close) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS c3 FROM z0),
    k AS (SELECT *, CAST(coalesce(close > hi, false) AS INTEGER) AS u, CAST(coalesce(close < lo, false) AS INTEGER) AS dn, CAST(coalesce(close > hi AND l5 <= hi, false) AS INTEGER) AS rt, CAST(coalesce(close > hi AND c3 < hi, false) AS INTEGER) AS fl FROM z),
    q AS (SELECT *, coalesce(lag(u) OVER ({S}), 0) AS up, coalesce(lag(dn) OVER ({S}), 0) AS down, coalesce(lag(rt, 5) OVER ({S}), 0) AS retest, coalesce(lag(fl, 5) OVER ({S}), 0) AS fail, coalesce(1 / (1 + CASE WHEN lb IS NOT NULL THEN greatest(lb - close, close - lt, 0) END / nullif(a, 0)), 0) AS near FROM k),
    s AS (SELECT *, least(1.0, 0.5 * up + 0.35 * down) AS s1, 0.0 AS s2, least(1.0, 0.6 * near) AS s3, greatest(0.0, 0.4 - 0.5 * retest) AS s4, greatest(0.0, 0.25 * down - 0.15 * fail) AS s5 FROM q),
    v AS (SELECT *, least(1.0, (0.3 * s1 + 0.3 * s2 + 0.2 * s3 + 0.2 * s4 + 0.5 * s5) / 1.5) AS v FROM s)
    SELECT symbol, ts, {', '.join(r6(f'lag(s{k}) OVER ({S})', f'conf_{n}') for k, n in enumerate(conf.BASKETS, 1))}, {r6(f'coalesce(lag(v) OVER ({S}), 0.5)', 'conf_score')},
        CAST(coalesce(lag(v) OVER ({S}) >= 0.3, false) AS INTEGER) AS conf_strong, CAST(coalesce(lag(v) OVER ({S}) >= 0.15, false) AS INTEGER) AS conf_pass FROM v""")
on_bars("price_action", conf.price_action, BASKET)
on_bars("confluence_two_clips", lambda b: conf.score(b.withColumn("up", (F.col("close") > F.col("open")).cast("int")), {"confluence": F.lit(0.5), "conflict": F.col("up"), "bias_high": (F.col("high") - F.col("low")) / F.col("high"), "mc_quality": F.col("up") / 2, "break_up": F.col("up")}, {"extras": 1.0}), BASKET, f"""
    WITH {bars_cte()}, x AS (SELECT *, CAST(close > open AS INTEGER) AS up FROM b), y AS (SELECT *, least(1.0, greatest(0.0, 0.4 - 0.5 * up) + 0.2 * (high - low) / nullif(high, 0)) AS m, 0.2 * up + 0.1 * up AS e FROM x),
    v AS (SELECT *, (0.2 * m + e) / 2 AS v FROM y)
    SELECT symbol, ts, {', '.join(r6(f'lag({c}) OVER ({S})', f'conf_{n}') for c, n in (('0 * up', 'structure'), ('0 * up', 'zones'), ('0 * up', 'imbalance'), ('m', 'mtf'), ('e', 'extras')))}, {r6(f'coalesce(lag(v) OVER ({S}), 0.5)', 'conf_score')},
        CAST(coalesce(lag(v) OVER ({S}) >= 0.7, false) AS INTEGER) AS conf_strong, CAST(coalesce(lag(v) OVER ({S}) >= 0.35, false) AS INTEGER) AS conf_pass FROM v""")
on_bars("microchannel_quality", pat.microchannels, ["mc", "mc_length", "mc_quality"], f"""
    WITH {bars_cte()}, x AS (SELECT *, coalesce(CAST((high - close) / nullif(high - low, 0) <= 0.2 AS INTEGER), 0) AS nu, coalesce(CAST(low > lag(low) OVER ({S}) AS INTEGER), 0) AS hu, coalesce(CAST((close - low) / nullif(high - low, 0) <= 0.2 AS INTEGER), 0) AS nd, coalesce(CAST(high < lag(high) OVER ({S}) AS INTEGER), 0) AS hd FROM b),
    g AS (SELECT *, sum(CAST(nu + hu = 0 AS INTEGER)) OVER {ALLW} AS iu, sum(CAST(nd + hd = 0 AS INTEGER)) OVER {ALLW} AS id FROM x),
    r AS (SELECT *, sum(CAST(nu + hu > 0 AS INTEGER)) OVER u AS lu, sum(CAST(nd + hd > 0 AS INTEGER)) OVER d AS ld, sum(nu) OVER u AS cu, sum(hu) OVER u AS eu, sum(nd) OVER d AS cd, sum(hd) OVER d AS ed FROM g WINDOW u AS (PARTITION BY symbol, iu ORDER BY ts), d AS (PARTITION BY symbol, id ORDER BY ts)),
    k AS (SELECT *, CASE WHEN lu >= 3 AND lu >= ld THEN 1 WHEN ld >= 3 THEN -1 ELSE 0 END AS mc FROM r)
    SELECT symbol, ts, CAST(mc AS INTEGER) AS mc, CAST(CASE mc WHEN 1 THEN lu WHEN -1 THEN ld ELSE 0 END AS BIGINT) AS mc_length, {r6('CASE mc WHEN 1 THEN 0.5 * cu / lu + 0.5 * eu / lu WHEN -1 THEN 0.5 * cd / ld + 0.5 * ed / ld ELSE 0 END', 'mc_quality')} FROM k""")
FRACTALS_SQL = f"""f5 AS (SELECT *, count(*) OVER {w(5)} = 5 AS whole, lag(high, 2) OVER ({S}) AS fh, lag(low, 2) OVER ({S}) AS fl, max(high) OVER {w(5)} AS mh, min(low) OVER {w(5)} AS ml FROM b),
    fr AS (SELECT symbol, ts, 1 AS side, fh AS level FROM f5 WHERE whole AND fh = mh UNION ALL SELECT symbol, ts, -1, fl FROM f5 WHERE whole AND fl = ml),
    fl AS (SELECT DISTINCT symbol, level FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ts DESC) AS n FROM fr) WHERE n <= 10)"""
QUERIES["fractal_levels"] = lambda s, d: tidy(lv.fractal_levels(bars(s, d), 2, 10), ["symbol"], ["level"])
ORACLE_SQL["fractal_levels"] = f"WITH {bars_cte()}, {FRACTALS_SQL} SELECT symbol, {r6('level', 'level')} FROM fl"


def _clusters(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    days = bars(s, d, "D1")
    context = days.groupBy("symbol", "tf").agg((F.max_by("close", "ts") - F.min_by("close", "ts")).alias("slope"), F.avg(F.col("high") - F.col("low")).alias("adr")).withColumn("tf", F.lit("H1"))
    clusters = days.select("symbol", F.lit("H1").alias("tf"), "ts", F.col("close").alias("price"), F.col("volume").cast("double").alias("score"))
    return tidy(lv.enhanced_scores(clusters, context, lv.fractal_levels(b, 2, 10)), ["symbol", "ts"], ["price", "trend_score", "sr_score", "score"])


QUERIES["cluster_scores"] = _clusters
ORACLE_SQL["cluster_scores"] = f"""WITH {bars_cte()}, {FRACTALS_SQL}, {bars_cte('D1', 'd1')}, c AS (SELECT symbol, arg_max(close, ts) - arg_min(close, ts) AS sl, avg(high - low) AS adr FROM d1 GROUP BY symbol),
    h AS (SELECT d1.symbol, d1.ts, max(1 - abs(close - level) / (close * 0.05)) AS m, count(*) AS n FROM d1 JOIN fl ON fl.symbol = d1.symbol AND 1 - abs(close - level) / (close * 0.05) > 0 GROUP BY ALL),
    x AS (SELECT d1.symbol, d1.ts, close AS price, volume, tanh(CASE WHEN adr > 0 THEN sl / adr ELSE sl END) AS t, CASE WHEN m IS NULL THEN 0 ELSE least(1.0, m + 0.1 * (n - 1)) END AS sr FROM d1 JOIN c USING (symbol) LEFT JOIN h USING (symbol, ts))
    SELECT symbol, ts, {r6('price', 'price')}, {r6('t', 'trend_score')}, {r6('sr', 'sr_score')}, {r6('volume + 10 * t + 10 * sr', 'score')} FROM x"""
QUERIES["nearest_cluster"] = lambda s, d: tidy(lv.nearest_cluster(bars(s, d), bars(s, d, "D1").selectExpr("symbol", "'H1' tf", "ts + INTERVAL 1 DAY known_ts", "close price", "CAST(volume AS DOUBLE) score")), ["symbol", "ts"], ["nearest_price", "nearest_score", "nearest_signed"])
ORACLE_SQL["nearest_cluster"] = f"""WITH {bars_cte()}, {bars_cte('D1', 'd1')}, x AS (SELECT b.symbol, b.ts, b.close, d1.close AS p, d1.volume AS s, row_number() OVER (PARTITION BY b.symbol, b.ts ORDER BY abs(b.close - d1.close), d1.close, d1.volume) AS n FROM b LEFT JOIN d1 ON d1.symbol = b.symbol AND d1.ts + INTERVAL 1 DAY <= b.ts)
    SELECT symbol, ts, {r6('p', 'nearest_price')}, {r6('s', 'nearest_score')}, {r6('close - p', 'nearest_signed')} FROM x WHERE n = 1"""
on_bars("adaptive_tolerance", lambda b: roll.mfi(roll.atr_classic(b)).withColumns({"tol": lv.adaptive_tolerance(F.col("close"), F.col("atr"), 0.5, 0.05, 0.4), "extreme": lv.extreme_score(F.col("close"), 20.0, 80.0)}), ["tol", "extreme"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr FROM b), x AS (SELECT *, {ATR14} AS a FROM t)
    SELECT symbol, ts, {r6('CASE WHEN a IS NOT NULL THEN greatest(0.05, least(0.4, a / nullif(close, 0) * 0.5)) END', 'tol')}, {r6('CASE WHEN close >= 80 OR close <= 20 THEN 1 ELSE 1 - abs(close - 50) / 30 END', 'extreme')} FROM x""")

# -- grids, coverage and blocks ---------------------------------------------------------------------

QUERIES["observation_grid"] = lambda s, d: tidy(store.observation_grid(bars(s, d, "M30"), "M30", ["close", "volume"], [(2, 4)], False), ["symbol", "ts"], ["close", "volume", "filled"])
ORACLE_SQL["observation_grid"] = f"""WITH {bars_cte('M30')}, g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS t FROM b GROUP BY 1)
    SELECT g.symbol, g.t AS ts, {r6('b.close', 'close')}, b.volume, CAST(b.ts <> g.t AS INTEGER) AS filled FROM g ASOF LEFT JOIN b ON b.symbol = g.symbol AND g.t >= b.ts WHERE hour(g.t) NOT BETWEEN 2 AND 3 AND dayofweek(g.t) BETWEEN 1 AND 5"""


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two ranges for every symbol have no M15 bar."""
    made = bars(spark, sf_dir, "M15").select("symbol", "tf", "ts")
    wanted = made.select("symbol", "tf").distinct().withColumn("r", F.explode(F.expr("array(struct(TIMESTAMP_NTZ '2024-01-03' AS start, TIMESTAMP_NTZ '2024-01-09' AS end), struct(TIMESTAMP_NTZ '2023-12-30' AS start, TIMESTAMP_NTZ '2024-01-02' AS end))"))).select("symbol", "tf", "r.*")
    return store.missing_ranges(made, wanted).select("symbol", "start", "end")


QUERIES["missing_ranges"] = _missing
ORACLE_SQL["missing_ranges"] = f"""WITH {bars_cte('M15')}, w(a, e) AS (VALUES (TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-09'), (TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-02')), q AS (SELECT symbol, a, e, unnest(generate_series(a, e - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS t FROM (SELECT DISTINCT symbol FROM b), w),
    m AS (SELECT q.*, row_number() OVER (PARTITION BY q.symbol, q.a ORDER BY t) AS n FROM q LEFT JOIN b ON b.symbol = q.symbol AND b.ts = q.t WHERE b.ts IS NULL)
    SELECT symbol, min(t) AS start, max(t) + INTERVAL 15 MINUTE AS "end" FROM m GROUP BY symbol, a, t - n * INTERVAL 15 MINUTE"""
BLOCKS = {"ema": lambda b: blk.ema(b, period=9, length="7 days"), "rsi": lambda b: blk.rsi(b, period=6, length="1 day"), "kama": lambda b: blk.kama(b, period=8, length="3 days")}
BLOCKS_SQL = f"""WITH RECURSIVE {bars_cte()}, x AS (SELECT *, row_number() OVER ({S}) AS n, close - lag(close) OVER ({S}) AS c, lag(close, 7) OVER ({S}) AS far FROM b), y AS (SELECT *, greatest(c, 0) AS g, greatest(-c, 0) AS l, sum(abs(c)) OVER {w(7)} AS way FROM x),
    z AS (SELECT *, avg(g) OVER {w(6)} AS mg, avg(l) OVER {w(6)} AS ml, power(CASE WHEN way < 1e-9 THEN 0 ELSE abs(close - far) / way END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc FROM y),
    r AS (SELECT symbol, ts, n, close AS e, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS k FROM z WHERE n = 1
        UNION ALL SELECT z.symbol, z.ts, z.n, 0.2 * z.close + 0.8 * r.e, CASE WHEN z.n = 7 THEN z.mg WHEN z.n > 7 THEN 2.0 / 7 * z.g + 5.0 / 7 * r.u END, CASE WHEN z.n = 7 THEN z.ml WHEN z.n > 7 THEN 2.0 / 7 * z.l + 5.0 / 7 * r.d END, CASE WHEN z.n = 8 THEN z.close WHEN z.n > 8 THEN z.sc * z.close + (1 - z.sc) * r.k END
        FROM r JOIN z ON z.symbol = r.symbol AND z.n = r.n + 1)"""
for _name, _value in (("ema", "CASE WHEN n >= 9 THEN e END"), ("rsi", "CASE WHEN d = 0 THEN CASE WHEN u = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + u / d) END"), ("kama", "k")):
    on_bars(f"blocks_{_name}", BLOCKS[_name], [_name], f"{BLOCKS_SQL} SELECT symbol, ts, {r6(_value, _name)} FROM r")

# -- rules of risk beyond caps ----------------------------------------------------------------------

WANTED = ("symbol", "ts", "close price", "10000D equity", "coalesce(roc, 0) / 200 exposure", "0.01D risk", "close - CASE WHEN volume % 3 = 0 THEN -5 ELSE 5 END * sign(coalesce(roc, 0)) stop_price")
WANTED_SQL = f"{bars_cte()}, x0 AS (SELECT *, (close - lag(close, 3) OVER ({S})) / nullif(lag(close, 3) OVER ({S}), 0) * 100 AS roc FROM b), x AS (SELECT symbol, ts, close AS p, coalesce(roc, 0) / 200 AS e, close - CASE WHEN volume % 3 = 0 THEN -5 ELSE 5 END * sign(coalesce(roc, 0)) AS st FROM x0)"


def _wanted(s: SparkSession, d: str) -> DataFrame:
    return roll.roc(bars(s, d), period=3).selectExpr(*WANTED)


QUERIES["stop_alignment"] = lambda s, d: tidy(acc.stop_alignment(_wanted(s, d)).fillna("", ["stop_problem"]), ["symbol", "ts"], ["stop_problem"])
ORACLE_SQL["stop_alignment"] = f"WITH {WANTED_SQL} SELECT symbol, ts, CASE WHEN abs(e) <= 1e-12 THEN 'flat' WHEN e > 0 AND st >= p THEN 'long_stop_not_below' WHEN e < 0 AND st <= p THEN 'short_stop_not_above' ELSE '' END AS stop_problem FROM x"
CAPS_SQL = f"{WANTED_SQL}, y AS (SELECT *, 10000 * abs(e) / nullif(p, 0) AS lots, 100 / nullif(abs(p - st), 0) AS stop_lots FROM x), c AS (SELECT *, coalesce(abs(e) > 1e-12 AND lots > stop_lots, false) AS over, CASE WHEN abs(e) > 1e-12 AND lots > stop_lots THEN e * stop_lots / lots ELSE e END AS cap FROM y)"
QUERIES["stop_caps"] = lambda s, d: tidy(acc.stop_caps(_wanted(s, d)), ["symbol", "ts"], ["exposure", "capped_exposure", "stop_capped"])
ORACLE_SQL["stop_caps"] = f"WITH {CAPS_SQL} SELECT symbol, ts, {r6('e', 'exposure')}, {r6('cap', 'capped_exposure')}, CAST(over AS INTEGER) AS stop_capped FROM c"


def _modifications(s: SparkSession, d: str) -> DataFrame:
    limited = acc.risk_limits(acc.stop_caps(_wanted(s, d)).withColumns({"wanted": F.col("exposure"), "exposure": F.col("capped_exposure")}), "ts")
    return tidy(acc.modifications(limited, "ts", {"STOP_LOSS_RISK_CAP": ("wanted", "exposure"), "MAX_SYMBOL_EXPOSURE": ("exposure", "capped"), "MAX_TOTAL_EXPOSURE": ("capped", "final")}), ["ts", "symbol", "code"], ["requested", "final"])


QUERIES["risk_modifications"] = _modifications
ORACLE_SQL["risk_modifications"] = f"""WITH {CAPS_SQL}, l AS (SELECT *, sign(cap) * least(abs(cap), 0.3) AS lim FROM c), t AS (SELECT *, sum(abs(lim)) OVER (PARTITION BY ts) AS t FROM l), f AS (SELECT *, CASE WHEN t > 1 THEN lim / t ELSE lim END AS f FROM t)
    SELECT ts, symbol, 'STOP_LOSS_RISK_CAP' AS code, {r6('e', 'requested')}, {r6('cap', '"final"')} FROM f WHERE e <> cap UNION ALL SELECT ts, symbol, 'MAX_SYMBOL_EXPOSURE', {r6('cap', 'requested')}, {r6('lim', '"final"')} FROM f WHERE cap <> lim
    UNION ALL SELECT ts, symbol, 'MAX_TOTAL_EXPOSURE', {r6('lim', 'requested')}, {r6('f', '"final"')} FROM f WHERE lim <> f"""
QUERIES["resize"] = lambda s, d: tidy(acc.resize(bars(s, d).selectExpr("symbol", "ts", "close - 50 AS own", "high - low + 1 AS reference"), "ts", "own", "reference"), ["symbol", "ts"], ["resized"])
ORACLE_SQL["resize"] = f"WITH {bars_cte()}, x AS (SELECT symbol, ts, greatest(0, close - 50) AS v, sum(greatest(0, close - 50)) OVER (PARTITION BY ts) AS h, sum(high - low + 1) OVER (PARTITION BY ts) AS r FROM b) SELECT symbol, ts, {r6('CASE WHEN h > 0 THEN v * r / h ELSE 0 END', 'resized')} FROM x"
on_bars("affordable_lots", lambda b: b.withColumn("lots", acc.affordable_lots(F.col("volume").cast("double") / 3, F.col("close") - 20, F.col("open"), 0.1, 0.1, 50.0)), ["lots"], f"""
    WITH {bars_cte()}, x AS (SELECT *, round(round_even(greatest(0.1, least(50.0, volume / 3.0)) / 0.1, 0) * 0.1, 4) AS want, round(floor((close - 20) / open / 0.1 + 1e-9) * 0.1, 4) AS room FROM b),
    y AS (SELECT *, CASE WHEN want * open <= close - 20 THEN want ELSE least(want, room) END AS fits FROM x) SELECT symbol, ts, {r6('CASE WHEN close <= 20 OR fits < 0.1 THEN 0 ELSE fits END', 'lots')} FROM y""")

# -- wide frames and rows at a time --------------------------------------------------------------------


def _wide(s: SparkSession, d: str) -> DataFrame:
    return j.align(bars(s, d), "H1", {tf: bars(s, d, tf).withColumn("volume", F.col("volume").cast("double")) for tf in ("H4", "D1")}, ["close", "volume"])


QUERIES["timeframe_view"] = lambda s, d: tidy(views.of_timeframe(_wide(s, d), "H4"), ["symbol", "ts"], ["close", "volume"])
ORACLE_SQL["timeframe_view"] = f"""WITH {bars_cte()}, {H4}, x AS (SELECT *, ts + INTERVAL 60 MINUTE AS at FROM b), a AS (SELECT *, ts + INTERVAL 240 MINUTE AS at FROM h4)
    SELECT x.symbol, x.ts, {r6('a.close', 'close')}, {r6('a.volume', 'volume')} FROM x ASOF JOIN a ON x.symbol = a.symbol AND x.at >= a.at"""
on_bars("finite_values", lambda b: views.finite(b.withColumn("x", F.when(F.col("volume") % 5 == 0, F.lit(float("inf"))).when(F.col("volume") % 5 == 1, F.lit(float("nan"))).otherwise((F.col("volume") / 4).cast("double"))), ["x"]).withColumn("x", F.col("x").cast("double")), ["x"], f"""
    WITH {bars_cte()} SELECT symbol, ts, {r6('CASE WHEN volume % 5 > 1 THEN volume / 4 END', 'x')} FROM b""")
AT = [("click", "2024-01-10 10:30:00"), ("view", None), ("purchase", "2020-01-01 00:00:00"), ("nobody", None)]
QUERIES["at_or_before"] = lambda s, d: tidy(views.at_or_before(bars(s, d), s.createDataFrame(AT, "symbol string, at string").withColumn("at", F.col("at").cast("timestamp_ntz")), "close"), ["symbol", "at"], ["close"])
ORACLE_SQL["at_or_before"] = f"""WITH {bars_cte()}, a(symbol, moment) AS (VALUES {', '.join(f'({s!r}, CAST({t!r} AS TIMESTAMP))' if t else f'({s!r}, CAST(NULL AS TIMESTAMP))' for s, t in AT)}) SELECT a.symbol, moment AS "at", {r6('(SELECT arg_max(close, ts) FROM b WHERE b.symbol = a.symbol AND (moment IS NULL OR ts <= moment))', 'close')} FROM a"""

# -- specifications, scan requests, instruments and news ranges --------------------------------------------

#: Specifications made of a part's size n, and what each means with its defaults, or why it means nothing.
SPEC_CASES = [
    ("sma(close, {n})", "sma(column=close,period={n},min_periods=-1)"), ("EMA(high, {n})@m15", "ema(column=high,period={n},min_periods=-1)@M15"), ("rsi(n={n}, method=wilders)@4h", "rsi(column=close,period={n},method=wilders)@H4"),
    ("bb(close, {n}, k=1.5)", "bollinger_bands(column=close,period={n},multiplier=1.5,min_periods=-1)"), ("macd(fast=5, slow={n})@D1", "macd(column=close,fast=5,slow={n},signal=9)@D1"), ("sma(volume, {n})", ""), ("nothing({n})", ""), ("ema({n}, period=4, period=5)", ""), ("sma(close, {n}", ""), ("atr({n})@H7", ""), ("cci({n}, 2, 3, 4)", ""),
]


def _specs(spark: SparkSession, sf_dir: str, make: Callable[[str, int], str]) -> DataFrame:
    """Each distinct specification text that the parts give, with what ``make`` finds of it."""
    size = F.col("p_size").cast("string")
    text = F.get(F.array(*(F.concat(F.lit(a), size, F.lit(b)) for a, b in (t.split("{n}") for t, _ in SPEC_CASES))), (F.col("p_partkey") % len(SPEC_CASES)).cast("int"))
    texts = spark.read.parquet(f"{sf_dir}/part.parquet").select(text.alias("spec"), F.col("p_size").cast("int").alias("n")).distinct()

    def run(frames):
        for frame in frames:
            yield frame.assign(meaning=[make(t, n) for t, n in zip(frame.spec, frame.n, strict=True)])[["spec", "meaning"]]

    return texts.mapInPandas(run, "spec string, meaning string")


def _meaning(text: str, n: int) -> str:
    try:
        return parse(text, REGISTRY).canonical
    except SpecError:
        return ""


def _replaced(text: str, n: int) -> str:
    found = _meaning(text, n)
    return replace_params(found, REGISTRY, **({"slow": n + 1} if found.startswith("macd") else {"period": n + 1})) if found else ""


def _specs_sql(of: Callable[[str], str]) -> str:
    put = lambda t: "'" + t.replace("{n}", "' || n || '").replace("{m}", "' || (n + 1) || '") + "'"
    cases = lambda texts: "CASE k " + " ".join(f"WHEN {i} THEN {put(t)}" for i, t in enumerate(texts)) + " END"
    return f"SELECT DISTINCT {cases([t for t, _ in SPEC_CASES])} AS spec, {cases([of(m) for _, m in SPEC_CASES])} AS meaning FROM (SELECT p_partkey % {len(SPEC_CASES)} AS k, CAST(p_size AS INTEGER) AS n FROM part)"


QUERIES["spec_parse"] = lambda s, d: _specs(ship(s), d, _meaning)
ORACLE_SQL["spec_parse"] = _specs_sql(lambda m: m)
QUERIES["spec_replace"] = lambda s, d: _specs(ship(s), d, _replaced)
ORACLE_SQL["spec_replace"] = _specs_sql(lambda m: m.replace("{n}", "{m}"))
FEATURE_SET = ["sma(close,30)@H1", "ema(close,50)@H4", "rsi(close,14)", "tema(close,10)@D1", "adx(14)@H4", "macd@D1"]


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the features need for every symbol there is, against a depth by how many ticks it has."""
    need = spark.createDataFrame(list(plans.warmup(plans.plan(FEATURE_SET, "H1")).items()), "tf string, needed long")
    symbols = ticks(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    depths = symbols.select("symbol", F.explode(F.array(F.struct(F.lit("H1").alias("tf"), (F.col("n") % 60).alias("needed")), F.struct(F.lit("M5").alias("tf"), (F.col("n") % 7).alias("needed")))).alias("d")).select("symbol", "d.*")
    return req.required_bars(symbols.select("symbol").crossJoin(F.broadcast(need)), depths)


QUERIES["required_bars"] = _required
ORACLE_SQL["required_bars"] = """WITH s AS (SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1), u AS (SELECT symbol, tf, needed FROM s, (VALUES ('H1', 30), ('H4', 50), ('D1', 34)) v(tf, needed)
    UNION ALL SELECT symbol, 'H1', n % 60 FROM s UNION ALL SELECT symbol, 'M5', n % 7 FROM s) SELECT symbol, tf, CAST(max(needed) AS BIGINT) AS needed FROM u GROUP BY ALL"""
QUERIES["scan_periods"] = lambda s, d: tidy(req.ScanRequest("view", "H1", ("H4",), "periods", 5, 2, "D1").apply(bars(s, d).unionByName(bars(s, d, "H4")), dt.datetime(2024, 1, 20, 13, 30)), ["symbol", "tf", "ts"], ["close"])
ORACLE_SQL["scan_periods"] = f"""WITH {bars_cte()}, {H4}, u AS (SELECT *, 'H1' AS tf FROM b UNION ALL SELECT *, 'H4' FROM h4) SELECT symbol, tf, ts, {r6('close', 'close')} FROM u WHERE symbol = 'view' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-18'"""
QUERIES["scan_number"] = lambda s, d: tidy(req.ScanRequest("click", "H1", (), "number", 40, 5).apply(bars(s, d)), ["symbol", "ts"], ["close"])
ORACLE_SQL["scan_number"] = f"WITH {bars_cte()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) SELECT symbol, ts, {r6('close', 'close')} FROM n WHERE symbol = 'click' AND k BETWEEN 6 AND 40"
QUERIES["picked_volume"] = lambda s, d: req.pick_volume(bars(s, d).withColumns({"tick_volume": F.when(F.col("symbol") != "view", F.col("volume")), "real_volume": F.col("volume") * 3})).select("symbol", "ts", "volume")
ORACLE_SQL["picked_volume"] = f"WITH {bars_cte()} SELECT symbol, ts, CAST(volume * CASE WHEN symbol = 'view' THEN 3 ELSE 1 END AS BIGINT) AS volume FROM b"
QUERIES["instrument_values"] = lambda s, d: tidy(req.instruments(s.read.parquet(f"{d}/part.parquet").selectExpr("CAST(p_partkey AS STRING) symbol", "p_size / 100D tick_size", "p_size / 50D tick_value", "0.1D pip_size", "0.01D point", "CAST(CASE WHEN p_size % 3 > 0 THEN p_size END AS INT) stop_level", "100D contract_size", "0.01D volume_step", "0.01D volume_min", "50D volume_max")), ["symbol"], ["value_per_unit", "pip_value", "stop_distance"])
ORACLE_SQL["instrument_values"] = f"SELECT CAST(p_partkey AS VARCHAR) AS symbol, {r6('(p_size / 50) / (p_size / 100)', 'value_per_unit')}, {r6('(p_size / 50) / (p_size / 100) * 0.1', 'pip_value')}, {r6('CASE WHEN p_size % 3 > 0 THEN p_size * 0.01 ELSE 0 END', 'stop_distance')} FROM part"
QUERIES["news_ranges"] = lambda s, d: req.news_range(s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "ts time_utc", "upper(substr(event_type, 1, 3)) currency", "CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' ELSE 'low' END impact"), "2024-01-05", "2024-01-09", ["vie", "CLI"], ["high", "medium"]).select("event_id", "time_utc", "currency")
ORACLE_SQL["news_ranges"] = f"SELECT event_id, ts AS time_utc, upper(substr(event_type, 1, 3)) AS currency FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND event_type IN ('view', 'click') AND event_id % 3 < 2"
QUERIES["observation_vectors"] = lambda s, d: plans.vectors(roll.sma(roll.roc(bars(s, d), period=5), period=8), ["roc", "sma"]).selectExpr("symbol", "ts", "round(vector[0], 6) + 0 AS first", "round(vector[1], 6) + 0 AS second")
ORACLE_SQL["observation_vectors"] = f"""WITH {bars_cte()}, x AS (SELECT *, (close - lag(close, 5) OVER ({S})) / nullif(lag(close, 5) OVER ({S}), 0) * 100 AS r, {full(f'avg(close) OVER {w(8)}', 8)} AS m FROM b) SELECT symbol, ts, {r6('r', '"first"')}, {r6('m', '"second"')} FROM x WHERE r IS NOT NULL AND m IS NOT NULL"""

# -- older definitions and thresholds in ATR -----------------------------------------------------------------

ZERO_WMA = lambda c, n: f"CASE WHEN count(*) OVER {w(n)} = {n} THEN list_sum([z[1] * z[2] FOR z IN list_zip(list(coalesce({c}, 0)) OVER {w(n)}, range(1, {n + 1}))]) / {n * (n + 1) / 2} END"
on_bars("classic_weighted", lambda b: classic.hma(classic.wma(b, period=10), period=16), ["classic_wma", "classic_hma"], f"""
    WITH {bars_cte()}, x AS (SELECT *, {ZERO_WMA('close', 10)} AS w10, 2 * {ZERO_WMA('close', 8)} - {ZERO_WMA('close', 16)} AS d FROM b) SELECT symbol, ts, {r6('w10', 'classic_wma')}, {r6(ZERO_WMA('d', 4), 'classic_hma')} FROM x""")
on_bars("classic_means", lambda b: classic.keltner(classic.tema(classic.dema(b, period=6), period=6), 8), ["classic_dema", "classic_tema", "classic_kc_middle", "classic_kc_upper", "classic_kc_lower"], f"""
    WITH RECURSIVE {NB}, {recurrence('e1', 'b', *seed_terms('close', 6, 2 / 7))}, {recurrence('e2', '(SELECT symbol, rn, out AS x, rn AS ts FROM e1)', *seed_terms('x', 6, 2 / 7, 5))}, {recurrence('e3', '(SELECT symbol, rn, out AS x, rn AS ts FROM e2)', *seed_terms('x', 6, 2 / 7, 10))}, {recurrence('m', 'b', *seed_terms('close', 8, 2 / 9))},
    a AS (SELECT symbol, rn, {full(f'avg(tr) OVER {w(8)}', 8)} AS a FROM b)
    SELECT symbol, ts, {r6('2 * e1.out - e2.out', 'classic_dema')}, {r6('3 * e1.out - 3 * e2.out + e3.out', 'classic_tema')}, {r6('m.out', 'classic_kc_middle')}, {r6('m.out + 2 * a', 'classic_kc_upper')}, {r6('m.out - 2 * a', 'classic_kc_lower')}
    FROM b JOIN e1 USING (symbol, rn) JOIN e2 USING (symbol, rn) JOIN e3 USING (symbol, rn) JOIN m USING (symbol, rn) JOIN a USING (symbol, rn)""")
on_bars("classic_kama", lambda b: classic.kama(b), ["classic_kama"], f"""
    WITH RECURSIVE {NB}, c AS (SELECT *, abs(d) AS ad FROM b), e AS (SELECT *, abs(close - lag(close, 10) OVER ({S})) / nullif(CASE WHEN count(ad) OVER {w(10)} = 10 THEN sum(ad) OVER {w(10)} END, 0) AS er FROM c), s AS (SELECT *, pow(er * ({2 / 3} - {2 / 31}) + {2 / 31}, 2) AS sc FROM e),
    {recurrence('k', 's', 'CASE WHEN rn <= 10 THEN 0 ELSE 1 - coalesce(sc, 0) END', 'CASE WHEN rn <= 10 THEN close ELSE coalesce(sc * close, 0) END')} SELECT symbol, ts, {r6('k.out', 'classic_kama')} FROM b JOIN k USING (symbol, rn)""")
on_bars("adxr", lambda b: classic.adxr(b.withColumn("adx", F.when(F.row_number().over(src.series()) > 5, F.col("close"))), period=4), ["adxr"], f"""
    WITH {bars_cte()}, x AS (SELECT *, CASE WHEN row_number() OVER ({S}) > 5 THEN close END AS a FROM b) SELECT symbol, ts, {r6(f'0.5 * (a + lag(a, 4) OVER ({S}))', 'adxr')} FROM x""")
on_bars("classic_psar", classic.parabolic_sar, ["classic_psar"], f"""
    WITH RECURSIVE {NB}, x AS (SELECT symbol, rn, high, low, lag(high) OVER ({S}) AS h1, lag(high, 2) OVER ({S}) AS h2, lag(low) OVER ({S}) AS l1, lag(low, 2) OVER ({S}) AS l2 FROM b),
    p AS (SELECT symbol, rn, CASE WHEN high > h1 THEN l1 ELSE h1 END AS sar, CASE WHEN high > h1 THEN high ELSE low END AS ep, 0.02::DOUBLE AS af, high > h1 AS up FROM x WHERE rn = 2 UNION ALL
        SELECT symbol, rn, CASE WHEN turn THEN ep ELSE s1 END, CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
            CASE WHEN turn THEN 0.02 WHEN up AND high > ep OR NOT up AND low < ep THEN least(af + 0.02, 0.2) ELSE af END, up <> turn
        FROM (SELECT *, CASE WHEN up THEN low < s1 ELSE high > s1 END AS turn FROM (SELECT x.*, p.ep, p.af, p.up, CASE WHEN p.up THEN least(p.sar + p.af * (p.ep - p.sar), x.l1, x.l2) ELSE greatest(p.sar + p.af * (p.ep - p.sar), x.h1, x.h2) END AS s1 FROM p JOIN x ON x.symbol = p.symbol AND x.rn = p.rn + 1)))
    SELECT symbol, ts, {r6('CASE WHEN rn > 2 THEN sar END', 'classic_psar')} FROM b LEFT JOIN p USING (symbol, rn)""")
on_bars("classic_supertrend", classic.supertrend, ["classic_st", "classic_st_dir"], f"""
    WITH RECURSIVE {NB}, x AS (SELECT symbol, ts, rn, close, (high + low) / 2 + 3 * a AS top, (high + low) / 2 - 3 * a AS bot FROM (SELECT *, {full(f'avg(tr) OVER {w(10)}', 10)} AS a FROM b)),
    s AS (SELECT symbol, rn, top AS line FROM x WHERE rn = 1 UNION ALL SELECT x.symbol, x.rn, CASE WHEN s.line IS NULL THEN x.top WHEN x.close > s.line THEN greatest(s.line, x.bot) ELSE least(s.line, x.top) END FROM s JOIN x ON x.symbol = s.symbol AND x.rn = s.rn + 1)
    SELECT symbol, ts, {r6('line', 'classic_st')}, {r6('CASE WHEN line IS NOT NULL THEN CASE WHEN close > line THEN 1 ELSE -1 END END', 'classic_st_dir')} FROM x JOIN s USING (symbol, rn)""")


def _atr_patterns(b: DataFrame) -> DataFrame:
    b = roll.atr_classic(b)
    return pat.strong_three(pat.tweezer(pat.inside_outside(pat.doji(b, 0.5, "atr", 0.3), "atr", 0.3, strict=False), 0.2, "atr"), "atr", 0.1)


on_bars("candle_patterns_atr", _atr_patterns, ["doji", "inside_bar", "outside_bar", "tweezer_top", "tweezer_bottom", "strong_soldiers", "strong_crows"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr, lag(high) OVER ({S}) AS h1, lag(low) OVER ({S}) AS l1 FROM b), x AS (SELECT *, {ATR14} AS a, abs(close - open) AS body, high - low AS span FROM t),
    y AS (SELECT *, body / nullif(span, 0) <= 0.5 AND body / nullif(a, 0) <= 0.3 AS d, span >= 0.3 * nullif(a, 0) AS wide, 0.2 * nullif(a, 0) / nullif((high + low) / 2, 0) AS reach, CASE WHEN body / nullif(a, 0) >= 0.1 THEN sign(close - open) END AS s FROM x),
    z AS (SELECT *, lag(s) OVER ({S}) AS s1, lag(s, 2) OVER ({S}) AS s2 FROM y)
    SELECT symbol, ts, {', '.join(f'CAST(coalesce({v}, false) AS INTEGER) AS {k}' for k, v in {'doji': 'd', 'inside_bar': 'high <= h1 AND low >= l1 AND wide', 'outside_bar': 'high >= h1 AND low <= l1 AND wide', 'tweezer_top': 'abs(high - h1) <= reach * abs(h1)', 'tweezer_bottom': 'abs(low - l1) <= reach * abs(l1)', 'strong_soldiers': 's = 1 AND s1 = 1 AND s2 = 1', 'strong_crows': 's = -1 AND s1 = -1 AND s2 = -1'}.items())} FROM z""")
on_bars("strong_zones", lambda b: pat.strong_order_block(pat.fair_value_gap(roll.atr_classic(b), 2, "atr", 0.1), "atr", 0.3, 1.5), ["fvg", "fvg_bottom", "fvg_top", "ob", "ob_bottom", "ob_top"], f"""
    WITH {bars_cte()}, t AS (SELECT *, {TR} AS tr, lag(high, 2) OVER ({S}) AS h2, lag(low, 2) OVER ({S}) AS l2, abs(lag(close) OVER ({S}) - lag(open) OVER ({S})) AS mb FROM b), x AS (SELECT *, {ATR14} AS a FROM t),
    k AS (SELECT *, CASE WHEN low > h2 AND low - h2 >= 0.1 * a AND mb >= 0.1 * a THEN 1 WHEN high < l2 AND l2 - high >= 0.1 * a AND mb >= 0.1 * a THEN -1 ELSE 0 END AS f, coalesce(close > max(high) OVER {P5}, false) AS up, coalesce(close < min(low) OVER {P5}, false) AS dn,
        CASE WHEN abs(close - open) / nullif(a, 0) >= 0.3 AND (high - low - abs(close - open)) / nullif(abs(close - open), 0) <= 1.5 THEN sign(close - open) END AS s FROM x),
    z AS (SELECT *, {', '.join(f"last_value(CASE WHEN s = {v} THEN {c} END IGNORE NULLS) OVER {ALLW} AS {n}" for v, c, n in ((-1, 'open', 'bt'), (-1, 'close', 'bb'), (1, 'close', 'rt'), (1, 'open', 'rb')))}, lag(up) OVER ({S}) AS up1, lag(dn) OVER ({S}) AS dn1 FROM k),
    o AS (SELECT *, CASE WHEN up1 AND bt IS NOT NULL THEN 1 WHEN dn1 AND rt IS NOT NULL THEN -1 ELSE 0 END AS o FROM z)
    SELECT symbol, ts, CAST(coalesce(lag(f) OVER ({S}), 0) AS INTEGER) AS fvg, {r6(f'lag(CASE f WHEN 1 THEN h2 WHEN -1 THEN high END) OVER ({S})', 'fvg_bottom')}, {r6(f'lag(CASE f WHEN 1 THEN low WHEN -1 THEN l2 END) OVER ({S})', 'fvg_top')},
        CAST(o AS INTEGER) AS ob, {r6('CASE o WHEN 1 THEN bb WHEN -1 THEN rb END', 'ob_bottom')}, {r6('CASE o WHEN 1 THEN bt WHEN -1 THEN rt END', 'ob_top')} FROM o""")
