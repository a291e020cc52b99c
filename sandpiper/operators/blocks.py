"""Recurrences over series that outgrow a task: blocks of time, the rows before each that its windows reach, and a carry between them.

Steps y -> a * y + b compose to such a step, so each block is composed by itself, what a block starts from comes from a small
ordered pass over the blocks, and then each block is gone through once more. A task holds one block, however long the series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sandpiper.operators.recursive import doubles, scan
from sandpiper.session import ship
from sandpiper.sources.candles import KEY

BLOCK = "30 days"
OWN = (*KEY, "__block")
#: (columns with NaN for null) -> the values that are counted; (columns, running count) -> a and b of each recurrence.
Values = Callable[[dict[str, np.ndarray]], np.ndarray]
Terms = Callable[[dict[str, np.ndarray], np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def block_of(ts: str, length: str) -> Column:
    """The number of the block of a time, for lengths such as ``30 days`` or ``1 hour``; blocks count from 1970-01-01."""
    number, unit = length.split()
    seconds = int(number) * {"minute": 60, "hour": 3600, "day": 86_400}[unit.lower().rstrip("s")]
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def with_rows_before(df: DataFrame, n: int, length: str = BLOCK) -> DataFrame:
    """The rows by __block, each block with the n rows of its series before it (__own: whether a row is the block's own).

    Which blocks hold these rows is known from the blocks' sizes alone: one row for each block. A block's last rows go to
    those after it that reach them; a row is copied more than once only where blocks have fewer than n rows.
    """
    own = df.withColumns({"__block": block_of("ts", length), "__own": F.lit(True)})
    if not n:
        return own
    line = Window.partitionBy(*KEY).orderBy("__block")
    sizes = own.groupBy(*OWN).agg(F.count("*").alias("__size"))
    sizes = sizes.withColumn("__upto", F.sum("__size").over(line))
    after = F.collect_list(F.struct(F.col("__block").alias("to"), (F.col("__upto") - F.col("__size")).alias("before"))).over(line.rowsBetween(1, n))
    reach = sizes.withColumn("__after", after).select(*OWN, "__upto", F.explode(F.filter("__after", lambda t: t["before"] - F.col("__upto") < n)).alias("__t"))
    last = own.withColumn("__back", F.row_number().over(Window.partitionBy(*OWN).orderBy(F.desc("ts")))).filter(F.col("__back") <= n)
    copied = last.join(reach, list(OWN)).filter(F.col("__upto") - F.col("__back") + 1 > F.col("__t.before") - n)
    return own.unionByName(copied.withColumns({"__block": F.col("__t.to"), "__own": F.lit(False)}).select(*own.columns))


def recur_in_blocks(df: DataFrame, reads: list[str], outs: list[str], values: Values, terms: Terms, n: int, length: str = BLOCK, count: str = "__count") -> DataFrame:
    """Append ``outs``, a recurrence y = a * y_before + b each, and ``count``, the running number of values, to every series.

    terms gives a and b for a block's rows and the n before them, from the columns ``reads`` and the running count; NaN in b gives null and
    keeps y, and a = 0 starts anew. Equal to one pass over the whole series at any length of the blocks.
    """
    ship(df.sparkSession)
    rows = with_rows_before(df, n, length)
    fields = df.schema.fields
    names = [f.name for f in fields]
    made_of = len(outs)

    def opened(table: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], np.ndarray]:
        table = table.sort_by("ts")
        return table, {c: doubles(table, c) for c in reads}, table.column("__own").to_numpy()

    def key_of(table: pa.Table) -> list:
        return [table.column(c)[:1] for c in OWN]

    def running(columns: dict[str, np.ndarray], own: np.ndarray, seen: int) -> np.ndarray:
        """The count of values up to each row: ``seen`` before the block's first own row."""
        have = np.cumsum(~np.isnan(values(columns)))
        at = np.flatnonzero(own)[0]
        return have - (have[at - 1] if at else 0) + seen

    def counted(table: pa.Table) -> pa.Table:
        table, columns, own = opened(table)
        return pa.table([*key_of(table), pa.array([int((~np.isnan(values(columns)) & own).sum())])], names=[*OWN, "__n"])

    def composed(table: pa.Table) -> pa.Table:
        table, columns, own = opened(table)
        out = []
        for a, b in terms(columns, running(columns, own, table.column("__seen")[0].as_py())):
            a, b = np.broadcast_to(a, b.shape)[own], b[own]
            have = ~np.isnan(b)
            start = scan(np.concatenate([[0.0], a[have]]), np.concatenate([[0.0], b[have]]))
            out += [float(np.prod(a[have])), float(start[-1]), float(have.any())]
        return pa.table([*key_of(table), table.column("__seen")[:1], pa.array([out])], names=[*OWN, "__seen", "__steps"])

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("__block")
        y, starts = np.full(made_of, np.nan), []
        for steps in table.column("__steps").to_pylist():
            starts.append(y.tolist())
            for k, (a, b, some) in enumerate(zip(steps[::3], steps[1::3], steps[2::3], strict=True)):
                if some:
                    y[k] = b if np.isnan(y[k]) else a * y[k] + b
        return pa.table([*(table.column(c) for c in (*OWN, "__seen")), pa.array(starts, pa.list_(pa.float64()))], names=[*OWN, "__seen", "__start"])

    def applied(table: pa.Table) -> pa.Table:
        table, columns, own = opened(table)
        start = table.column("__start")[0].as_py()
        seen = running(columns, own, table.column("__seen")[0].as_py())
        made = []
        for (a, b), y in zip(terms(columns, seen), start, strict=True):
            a, b = np.broadcast_to(a, b.shape)[own], b[own]
            first = [] if y is None or np.isnan(y) else [y]
            made.append(scan(np.concatenate([np.zeros(len(first)), a]), np.concatenate([first, b]))[len(first) :])
        kept = table.filter(pa.array(own))
        return pa.table([*(kept.column(c) for c in names), *(pa.array(y, pa.float64(), from_pandas=True) for y in made), pa.array(seen[own])], names=[*names, *outs, count])

    kinds = {f.name: f for f in rows.schema.fields}
    own = [kinds[c] for c in OWN]
    sizes = rows.groupBy(*OWN).applyInArrow(counted, StructType([*own, StructField("__n", LongType())]))
    line = Window.partitionBy(*KEY).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*OWN, F.coalesce(F.sum("__n").over(line), F.lit(0)).alias("__seen"))
    steps = rows.join(before, list(OWN)).groupBy(*OWN).applyInArrow(composed, StructType([*own, StructField("__seen", LongType())]).add("__steps", ArrayType(DoubleType())))
    starts = steps.groupBy(*KEY).applyInArrow(carried, StructType([*own, StructField("__seen", LongType())]).add("__start", ArrayType(DoubleType())))
    return rows.join(starts, list(OWN)).groupBy(*OWN).applyInArrow(applied, StructType([*fields, *(StructField(o, DoubleType()) for o in outs), StructField(count, LongType())]))


def _seeded(x: np.ndarray, value: np.ndarray, seen: np.ndarray, n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponential mean whose seed is the plain mean of the first n values."""
    full = np.concatenate([np.full(n - 1, np.nan), x])
    w = np.lib.stride_tricks.sliding_window_view(full, n)
    have = (~np.isnan(w)).sum(1)
    mean = np.where(have > 0, np.nan_to_num(w).sum(1) / np.maximum(have, 1), np.nan)
    return np.where((seen == n) & ~np.isnan(value), 0.0, 1 - alpha), np.where(seen == n, mean, np.where(seen > n, alpha * x, np.nan))


def _back(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]])


def ema(df: DataFrame, column: str = "close", period: int = 20, min_periods: int = -1, out: str = "ema", length: str = BLOCK) -> DataFrame:
    """recursive.ema in blocks."""
    alpha = 2 / (period + 1)

    def terms(rows, seen):
        x = rows[column]
        first = (seen == 1) & ~np.isnan(x)
        return [(np.where(first, 0.0, 1 - alpha), np.where(first, x, alpha * x))]

    made = recur_in_blocks(df, [column], [out], lambda rows: rows[column], terms, 0, length)
    return made.withColumn(out, F.when(F.col("__count") >= (period if min_periods == -1 else min_periods), F.col(out))).drop("__count")


def rsi(df: DataFrame, column: str = "close", period: int = 14, method: str = "ema", out: str = "rsi", length: str = BLOCK) -> DataFrame:
    """recursive.rsi in blocks."""
    alpha = {"ema": 2 / (period + 1), "wilders": 1 / period}[method]

    def change(rows):
        return rows[column] - _back(rows[column], 1)

    def terms(rows, seen):
        moved = change(rows)
        return [_seeded(np.maximum(x, 0), moved, seen, period, alpha) for x in (moved, -moved)]

    made = recur_in_blocks(df, [column], ["__up", "__down"], change, terms, period, length)
    value = F.when(F.col("__down") == 0, F.when(F.col("__up") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.col("__up") / F.col("__down")))
    return made.withColumn(out, value).drop("__up", "__down", "__count")


def kama(df: DataFrame, column: str = "close", period: int = 10, fast_span: int = 2, slow_span: int = 30, out: str = "kama", length: str = BLOCK) -> DataFrame:
    """recursive.kama in blocks."""
    quick, slow = 2 / (fast_span + 1), 2 / (slow_span + 1)

    def terms(rows, seen):
        x = rows[column]
        step = np.abs(x - _back(x, 1))
        w = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(period - 2, np.nan), step]), period - 1)
        way = np.where((~np.isnan(w)).any(1), np.nan_to_num(w).sum(1), np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            er = np.where(way < 1e-9, 0.0, np.abs(x - _back(x, period - 1)) / way)
        sc = (er * (quick - slow) + slow) ** 2
        first = (seen == period) & ~np.isnan(x)
        return [(np.where(first, 0.0, 1 - sc), np.where(seen == period, x, np.where(seen > period, sc * x, np.nan)))]

    return recur_in_blocks(df, [column], [out], lambda rows: rows[column], terms, period, length).drop("__count")
