"""An append-only ledger of fills: each fill_id is booked once, whatever comes again, across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sandpiper.session import ship
from sandpiper.streaming.ordered import STORE


class _Once(StatefulProcessor):
    """The first row of a key is accepted; all others are not."""

    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle) -> None:
        self.booked = handle.getValueState("booked", "n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        n = self.booked.get()[0] if self.booked.exists() else 0
        new["times_seen"] = range(n + 1, n + len(new) + 1)
        self.booked.update((n + len(new),))
        yield new


def booked_once(fills: DataFrame, key: str = "fill_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A stream's fills with times_seen (1 for the first of its key) and accepted (whether it is the first).

    Of fills with one key in one batch the first by ``order`` counts. A fill without a key is never accepted. What is kept is a
    number for each key, in the state store, so the ledger grows as its fills do.
    """
    spark = ship(fills.sparkSession)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    schema = ", ".join([*(f"{c} {k}" for c, k in fills.dtypes), "times_seen long"])
    out = fills.groupBy(key).transformWithStateInPandas(_Once(list(order)), schema, "append", "None")
    return out.withColumn("accepted", (F.col("times_seen") == 1) & F.col(key).isNotNull())


class Ledger:
    """Where booked fills go, for foreachBatch: entries and rejects of each batch under its number.

    A batch that is run again overwrites what it wrote before, so that nothing is booked twice. Total costs are read from entries only.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("accepted").parquet(f"{self.folder}/batch={batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, with batch and accepted."""
        return spark.read.parquet(self.folder).withColumn("accepted", F.col("accepted").cast("boolean"))

    def entries(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).filter("accepted").drop("accepted", "times_seen")

    def rejects(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).filter("NOT accepted").drop("accepted")
