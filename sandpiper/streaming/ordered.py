"""The rows of a stream's series, handed on in time order to a fold whose state Spark keeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sandpiper.session import ship

#: The state store that stateful processors need. Fixed value.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Base of folds over a series. Subclasses say what state they need (setup) and what a run of rows gives (advance).

    If the stream waits, rows stay in the state until the watermark has passed their time, whatever the order they came in; a timer
    at the oldest one wakes the series up. Of rows with the same order the one that came last counts. Else rows are handed on as they come,
    in the order of their batch, and those not after the newest so far are ignored.
    """

    def __init__(self, fields: list[str], order: list[str], waits: bool) -> None:
        # frames that reach a processor have no names with a leading underscore
        self.fields, self.order, self.waits = ["t_us", *fields], ["t_us", *order], waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "t long")
        if self.waits:
            self.waiting = handle.getListState("waiting", ", ".join(f"{f} {'long' if f == 't_us' else 'double'}" for f in self.fields))
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def advance(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """rows: in order, numbers as doubles with NaN for null, t_us in microseconds."""
        raise NotImplementedError

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[self.fields]
        if not self.waits:
            yield from self._hand_on(key, new)
            return
        self.waiting.appendList([tuple(r) for r in new.itertuples(index=False)])
        self._wake(int(new["t_us"].min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.fields)
        due = rows["t_us"] <= upto
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([tuple(r) for r in rows[~due].itertuples(index=False)])
            self._wake(int(rows["t_us"][~due].min()))
        yield from self._hand_on(key, rows[due])

    def _wake(self, at: int) -> None:
        """The first millisecond not before a time; a timer that is set already stays."""
        self.handle.registerTimer(-(-at // 1000))

    def _hand_on(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            rows = rows[rows["t_us"] > self.newest.get()[0]]
        rows = rows.drop_duplicates(self.order, keep="last").sort_values(self.order, kind="stable")
        if not len(rows):
            return
        self.newest.update((int(rows["t_us"].iloc[-1]),))
        yield self.advance(key, rows.astype({f: np.float64 for f in self.fields[1:]}).reset_index(drop=True))


def fold(stream: DataFrame, processor: InOrder, by: list[str], outputs: str, late: str | None, time: str = "ts") -> DataFrame:
    """The processor over every series of a stream: by, ``time`` and its outputs (as DDL).

    late: how long rows may come after newer ones; they are then put in order, and given once the watermark has passed them. None: they come in order.
    A session needs spark.sql.streaming.stateStore.providerClass to be STORE.
    """
    spark = ship(stream.sparkSession)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    rows = stream.withWatermark(time, late) if late else stream
    kinds = dict(stream.dtypes)
    rows = rows.select(*by, F.unix_micros(time).alias("t_us"), time, *(F.col(f).cast("double").alias(f) for f in processor.fields[1:]))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "t_us long", outputs])
    out = rows.groupBy(*by).transformWithStateInPandas(processor, schema, "append", "EventTime" if late else "None")
    return out.withColumn("t_us", F.timestamp_micros("t_us")).withColumnRenamed("t_us", time)


class Arrays:
    """State of a fold as named arrays of doubles, kept as one row of a ValueState."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getValueState(name, "names array<string>, kept array<array<double>>")

    def load(self) -> dict[str, np.ndarray]:
        if not self.state.exists():
            return {}
        names, kept = self.state.get()
        return {n: np.array(k, np.float64) for n, k in zip(names, kept, strict=True)}

    def save(self, kept: dict[str, np.ndarray]) -> None:
        self.state.update((list(kept), [np.asarray(k, np.float64).tolist() for k in kept.values()]))
