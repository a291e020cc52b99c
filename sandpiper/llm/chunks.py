"""Documents in chunks ordered by doc_id, and an exchange that tells each chunk which of its keys were seen before.

Passes over the documents work on the same chunks: the first sends the distinct keys of every chunk, packed as one
array for each bucket of keys; a bucket's task finds the keys that more chunks have and answers with a bit for every key
sent. The next pass makes the same keys again and reads the bits. Text is shuffled once, as all passes of a job read the same
exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandpiper.llm.tokens import relieve
from sandpiper.session import ship

#: Mean UTF-8 bytes of text in a chunk, and keys in a bucket, up to LEVEL bytes of text. Beyond, both grow with the square root
#: of the input, and so do their numbers: at 160 TB there are 2 million chunks of 80 MB, which bounds the memory of a
#: task, the bounds that the driver holds (32 MB) and the number of arrays sent (one for each chunk and bucket) alike.
CHUNK_BYTES = 1_500_000
BUCKET_KEYS = 1_000_000
LEVEL = 60e9
LEAST_BUCKETS = 32
#: Documents looked at for each chunk to set the bounds, and in all (two a chunk at least).
SAMPLES, MOST_SAMPLES = 16, 4_000_000
LOWEST = -(1 << 63)


def growth(total: int) -> float:
    return max(1.0, math.sqrt(total / LEVEL))


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """The documents with __chunk (int, rising with doc_id, null ids first) and __at, and the bytes of all texts.

    Rows that share a doc_id, or have none, are ordered by __at, a hash of their text, so that they can be dealt to several
    chunks too; only rows that are equal in both share one. The bounds are quantiles by size of a sample of the rows;
    they set how large chunks are, never what is found.
    """
    ship(docs.sparkSession)
    ids, at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), F.xxhash64("text")
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0))
    total, rows = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n = max(1, math.ceil(total / (chunk_bytes * growth(total))))
    bounds = np.zeros((2, 0), np.int64)
    if n > 1:
        each = max(1, rows // min(SAMPLES * n, max(MOST_SAMPLES, 2 * n)))
        some = docs.select(ids.alias("id"), at.alias("at"), size.alias("size")).filter(F.pmod(F.xxhash64("id", "at"), F.lit(each)) == 0)
        seen = some.groupBy("id", "at").agg(F.sum("size").alias("size")).toArrow()
        pair = np.stack([seen.column(c).to_numpy() for c in ("id", "at")])
        order = np.lexsort(pair[::-1])
        upto = np.cumsum(seen.column("size").to_numpy()[order])
        if len(upto):
            last = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, n) / n))
            bounds = pair[:, order[last]]

    @F.pandas_udf("int")
    def chunk(id: pd.Series, at: pd.Series) -> pd.Series:
        key, tie = id.to_numpy(), at.to_numpy()
        lo, hi = (np.searchsorted(bounds[0], key, side) for side in ("left", "right"))
        for k in np.flatnonzero(lo < hi):
            lo[k] += np.searchsorted(bounds[1, lo[k] : hi[k]], tie[k])
        return pd.Series(lo.astype(np.int32))

    return docs.withColumn("__at", at).withColumn("__chunk", chunk(ids, F.col("__at"))), total


def in_order(table: pa.Table) -> pa.Table:
    """Rows by doc_id (null first), then __at, then text."""
    ids, at = table.column("doc_id").to_pylist(), table.column("__at").to_pylist()
    texts = table.column("text").cast(pa.binary()).to_pylist()
    return table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, at[i], texts[i] or b"")), pa.int64()))


def bucket_count(total: int, key_bytes: int) -> int:
    """Buckets for a key in every key_bytes bytes of text."""
    return max(LEAST_BUCKETS, math.ceil(total / key_bytes / (BUCKET_KEYS * growth(total))))


class Keys:
    """The distinct keys of one chunk by bucket; every caller makes them in the same order."""

    def __init__(self, keys: np.ndarray, bucket: np.ndarray, buckets: int):
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        runs = np.flatnonzero(new)
        self.first = np.minimum.reduceat(order, runs) if len(runs) else order  # the key's first place
        self.run = np.empty(len(keys), np.int64)  # of every place
        self.run[order] = np.cumsum(new) - 1
        self.unique = ranked[runs]
        at = bucket[self.first]
        self.by_bucket = np.argsort(at, kind="stable")
        self.edges = np.searchsorted(at[self.by_bucket], np.arange(buckets + 1))

    def packed(self, chunk: int, dtype=np.uint64) -> pa.Table:
        ranked = self.unique[self.by_bucket].astype(dtype)
        have = np.flatnonzero(np.diff(self.edges))
        return pa.table({"bucket": pa.array(have.astype(np.int32)), "chunk": pa.array(np.full(len(have), chunk, np.int32)), "keys": pa.array([ranked[self.edges[b] : self.edges[b + 1]].tobytes() for b in have], pa.binary())})

    def answered(self, answers: pa.Table) -> np.ndarray:
        """For every distinct key the bit that came back (False where none came)."""
        out = np.zeros(len(self.unique), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            own = self.by_bucket[self.edges[b] : self.edges[b + 1]]
            out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        return out


PACKED = "bucket int, chunk int, keys binary"
ANSWER = "bucket int, chunk int, bits binary"


def answers(packed: DataFrame, dtype=np.uint64, earlier: bool = True) -> DataFrame:
    """(bucket, chunk, bits): keys that an earlier chunk has (or, if not ``earlier``, any other chunk).

    Rows without a bit set are left out. A bucket gets a chunk's key once, so copies don't make it larger.
    """

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        blobs = table.column("keys").to_pylist()
        parts = [np.frombuffer(blobs[i], dtype) for i in order]
        keys = np.concatenate(parts)
        ranks = np.argsort(keys, kind="stable")
        ranked = keys[ranks]
        same = ranked[1:] == ranked[:-1]
        seen = np.zeros(len(keys), bool)
        seen[ranks[1:][same]] = True
        if not earlier:
            seen[ranks[:-1][same]] = True
        ends = np.cumsum([len(p) for p in parts])
        marks = [seen[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]
        hit = [k for k, m in enumerate(marks) if m.any()]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(hit), pa.int32()), "chunk": pa.array(chunk[order][hit].astype(np.int32)), "bits": pa.array([np.packbits(marks[k]).tobytes() for k in hit], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, ANSWER)


def first_pass(docs: DataFrame, run: Callable[[pa.Table, int], pa.Table], schema: str = PACKED) -> DataFrame:
    """run(rows of a chunk in order, chunk) for every chunk."""

    def one(table: pa.Table) -> pa.Table:
        out = run(in_order(table), table.column("__chunk")[0].as_py())
        relieve()
        return out

    return docs.groupBy("__chunk").applyInArrow(one, schema)


def next_pass(docs: DataFrame, known: DataFrame, run: Callable[[pa.Table, pa.Table, int], pa.Table], schema) -> DataFrame:
    """run(rows of a chunk in order, what is known of the chunk, chunk); known has a column chunk."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(in_order(left), right, left.column("__chunk")[0].as_py())
        relieve()
        return out

    return docs.groupBy("__chunk").cogroup(known.groupBy("chunk")).applyInArrow(both, schema)
