"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from sandpiper.session import cut, ship


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard in 0 .. n - 1 of each 64-bit key, after Lamping and Veach (2014).

    No table of shards is kept; from n to n + 1 shards only 1 / (n + 1) of the keys move, all into the new one.
    """
    state = keys.astype(np.uint64).copy()
    at = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = np.minimum((at[live] + 1) * step, float(n)).astype(np.int64)
        live = live[ahead[live] < n]
    return at


def assign(docs: DataFrame, key: str, n_shards: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus shard, slot and grown_shard (the shard if there were one more).

    The key column decides alone (long; another type is hashed with xxhash64 first), so equal keys share a shard
    and a rerun gives the same shards. A null key counts as -1. slot numbers a shard's rows from 0 without gaps:
    every input partition numbers its own rows, and the counts of the partitions before it are added, so no shard is
    ever gathered in one task. An empty table gives an empty one. Other columns of the input are not read.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    value = F.col(key) if kind == "bigint" else F.col(key).cast("long") if kind in ("int", "smallint", "tinyint") else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    rows = docs.select(*keep, F.coalesce(value, F.lit(-1)).alias("__key"))
    schema = docs.select(*keep).schema
    for name, type_ in (("shard", IntegerType()), ("grown_shard", IntegerType()), ("__part", IntegerType()), ("__local", LongType())):
        schema = schema.add(name, type_)

    def numbered(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        for batch in batches:
            keys = batch.column("__key").to_numpy(zero_copy_only=False).view(np.uint64)
            shard, grown = jump_hash(keys, n_shards), jump_hash(keys, n_shards + 1)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=n_shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
            local += seen[shard]
            seen += count
            own = [c for c in batch.schema.names if c != "__key"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(shard.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
                names=[*own, "shard", "grown_shard", "__part", "__local"],
            )

    placed = cut(rows.mapInArrow(numbered, schema))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "__part").count().withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    out = placed.join(base, ["shard", "__part"])
    return out.select(*keep, "shard", (F.col("__base") + F.col("__local")).alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, under the law ``key``.

    size: UTF-8 bytes of the text plus 16 (null or empty: 16; crc 0). Repeated rows get a slot each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(rows, "doc_id", n_shards, ["doc_id", "size", "text_crc32", "law"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
