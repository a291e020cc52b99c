"""From specifications to a table of features, and from features to observations."""

from __future__ import annotations

import inspect
from collections import defaultdict
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.functions.spec import Spec, parse
from sandpiper.operators.joins import asof, candle_lags, close_time
from sandpiper.plans.registry import REGISTRY
from sandpiper.sources.candles import KEY, MINUTES, series, timeframe


def plan(specs: list[str], base_tf: str) -> list[Spec]:
    """Parsed, with the base timeframe where none is named, each once."""
    found = {}
    for text in specs:
        spec = parse(text, REGISTRY)
        spec = spec if spec.tf else Spec(spec.feature, timeframe(base_tf), spec.args)
        found[spec.canonical] = spec
    return list(found.values())


def warmup(specs: list[Spec]) -> dict[str, int]:
    """Bars that each timeframe needs before all its features have values."""
    need: dict[str, int] = defaultdict(int)
    for s in specs:
        need[s.tf] = max(need[s.tf], s.feature.warmup(dict(s.args)))
    return dict(need)


def apply(bars: DataFrame, spec: Spec) -> DataFrame:
    """Bars with the specification's columns, under their canonical names."""
    if missing := [c for c in spec.feature.requires if c not in bars.columns]:
        raise ValueError(f"{spec.canonical} needs {missing}")
    args = dict(spec.args)
    own = inspect.signature(spec.feature.run).parameters
    out = spec.feature.run(bars, **{k: v for k, v in args.items() if k in own})
    return out.select(*bars.columns, *(F.col(o).alias(spec.column(o)) for o in spec.feature.outputs))


def features(bars: dict[str, DataFrame], specs: list[str], base_tf: str) -> dict[str, DataFrame]:
    """For every timeframe its bars with the features named for it."""
    out = dict(bars)
    for spec in plan(specs, base_tf):
        if spec.tf not in out:
            raise ValueError(f"no bars for {spec.tf}")
        out[spec.tf] = apply(out[spec.tf], spec)
    return out


def select_columns(columns: list[str], allow: list[str] | None = None, deny: list[str] | None = None) -> list[str]:
    """Columns that match an allowed pattern (all, if none is given) and no denied one; a pattern without *?[ may be a part."""
    fits = lambda c, p: fnmatchcase(c, p) if any(x in p for x in "*?[") else p in c
    kept = [c for c in columns if not allow or any(fits(c, p) for p in allow)]
    return [c for c in kept if not deny or not any(fits(c, p) for p in deny)]


def drop_warmup(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without a series' rows before the first on which every column has a value; later gaps stay."""
    full = None
    for c in columns:
        full = F.col(c).isNotNull() if full is None else full & F.col(c).isNotNull()
    if full is None:
        return df
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.max(full).over(upto)).filter("__ok").drop("__ok")


def observations(tables: dict[str, DataFrame], base_tf: str, shift: int = 0, allow: list[str] | None = None, deny: list[str] | None = None, lags: dict[str, tuple[list[str], int]] | None = None) -> DataFrame:
    """Base rows with every timeframe's features as they were known when the base bar closed, ``shift`` base rows later.

    lags: for a timeframe the candle columns and how many closed bars back.
    """
    candle = {*KEY, "ts", "open", "high", "low", "close", "volume", "spread"}
    base_tf = timeframe(base_tf)
    own = select_columns([c for c in tables[base_tf].columns if c not in candle], allow, deny)
    out = close_time(tables[base_tf].select(*KEY, "ts", *own), base_tf)
    names = list(own)
    for tf in sorted(tables, key=MINUTES.__getitem__):
        cols = select_columns([c for c in tables[tf].columns if c not in candle], allow, deny)
        if tf != base_tf and cols:
            out = asof(out, close_time(tables[tf], tf).select("symbol", "at", *cols), "symbol")
            names += cols
    out = out.drop("at")
    if shift:
        out = out.withColumns({c: F.lag(c, shift).over(series()) for c in names})
    out = drop_warmup(out, names)
    for tf, (columns, depth) in (lags or {}).items():
        out = candle_lags(out, tables[tf], tf, columns, depth)
    return out


def vectors(obs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of every row as one array; rows with a null or non-finite entry are left out."""
    v = F.array(*(F.col(c).cast("double") for c in columns))
    rows = obs.select(*KEY, "ts", v.alias("vector"))
    return rows.filter(F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))))
