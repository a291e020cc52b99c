"""Best-fit packing of tokenised documents by exact complements."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.llm.bpe import coder, read_vocabulary
from sandpiper.llm.tokens import binary, parcels
from sandpiper.session import cut, ship


class Supply:
    """How many pieces of each length are left, and which of them add up to a gap."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def take(self, used: Counter) -> np.ndarray:
        """What is left beside the pieces already in the sequence."""
        left = self.left.copy()
        for length, k in used.items():
            left[length] -= k
        return left

    @staticmethod
    def pair(left: np.ndarray, total: int) -> tuple[int, tuple[int, int]]:
        """The pair of lengths adding up to total that can be had most often: (times, lengths)."""
        if total < 2 or total > 2 * (len(left) - 1):
            return 0, (0, 0)
        a = np.arange(max(1, total - len(left) + 1), total // 2 + 1)
        times = np.minimum(left[a], left[total - a])
        times = np.where(2 * a == total, left[a] // 2, times)
        best = int(np.argmax(times))
        return int(times[best]), (int(a[best]), int(total - a[best]))

    def exact(self, left: np.ndarray, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that fill the gap exactly and are left; () if there are none."""
        if gap < len(left) and left[gap] > 0:
            return (gap,)
        times, two = self.pair(left, gap)
        if times > 0:
            return two
        best, three = 0, ()
        for c in np.flatnonzero(left[: gap // 3 + 1] > 0):
            left[c] -= 1
            times, two = self.pair(left, gap - int(c))
            left[c] += 1
            if min(times, left[c]) > best:
                best, three = min(times, int(left[c])), (*two, int(c))
        return three if best > 0 else ()


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences to make: ([(length, pieces), ...], how many such sequences).

    counts[n]: pieces of length n, n below the capacity. The longest piece left is completed by a single length, a pair
    or a triple that fills its gap exactly; where none does, the longest piece that fits goes in and the rest of the
    gap is tried again. Each combination is used as often as the counts allow, so that a length runs out each time: the plan's
    size depends on the capacity alone, not on the number of documents.
    """
    supply = Supply(np.append(counts, np.zeros(max(0, capacity - len(counts)), np.int64)))
    out = []
    while (have := np.flatnonzero(supply.left)).size:
        longest = int(have[-1])
        used = Counter([longest])
        gap = capacity - longest
        while gap:
            left = supply.take(used)
            if fill := supply.exact(left, gap):
                used.update(fill)
                break
            fits = np.flatnonzero(left[: gap + 1] > 0)
            if not fits.size:
                break
            used[int(fits[-1])] += 1
            gap -= int(fits[-1])
        times = min(int(supply.left[n]) // k for n, k in used.items())
        for n, k in used.items():
            supply.left[n] -= times * k
        out.append((sorted(used.items(), reverse=True), times))
    return out


def places(steps, full: int, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, per, sequence, offset): pieces of a length ranked lo .. hi - 1 go to sequences from ``sequence``
    on, ``per`` in each, from ``offset`` on. full: pieces as long as the capacity."""
    used: Counter = Counter()
    rows, at = [(capacity, 0, full, 1, 0, 0)], full
    for members, times in steps:
        offset = 0
        for length, k in members:
            rows.append((length, used[length], used[length] + times * k, k, at, offset))
            used[length] += times * k
            offset += length * k
        at += times
    return rows


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the input partition and the rank in it by length."""
    spark = ship(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    end = np.array([end_id], "<u4").tobytes()
    extra = ", ids binary" if with_ids else ""

    def run(batches):
        code, part, seen = coder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in parcels(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch, "text"), strict=True):
                ids = code.encode(text.decode()) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(edges) - 1):
                    length = edges[k + 1] - edges[k]
                    own = ids[4 * edges[k] : 4 * edges[k + 1]]
                    rows.append((doc_id, k, edges[k], length, crc32(own), part, seen[length], own))
                    seen[length] += 1
            columns = [[r[i] for r in rows] for i in range(8)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            last = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:last], kinds, strict=False)], names=names[:last])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + extra)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every document.

    A document is its ids and end_id (a null or empty text: end_id alone). One longer than the capacity is cut into pieces
    of the capacity, the first of which takes the rest. Only the counts of the lengths below the capacity, at most
    capacity - 1 numbers, are planned on the driver; pieces get their place by their rank among those of their length,
    and no length is gathered in one task. Repeated rows are packed each. Other columns are not read.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, path, capacity, end_id, with_ids))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    rows = places(plan(counts[:capacity], capacity), int(counts[capacity]), capacity)
    to = spark.createDataFrame(rows, "p_length long, lo long, hi long, per long, sequence long, p_offset long")
    ranked = cuts.join(base, ["length", "part"]).withColumn("nth", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(to), (F.col("length") == F.col("p_length")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    own = F.col("nth") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(own / F.col("per"))).alias("sequence_id"),
        (F.col("p_offset") + own % F.col("per") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
