"""Exact top-k by inner product with Fagin's threshold algorithm, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.llm.vectors import integers, quantise, sound
from sandpiper.session import ship

#: Rows of a block of candidates and of a block of queries; they bound a task's memory.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
DEPTH = 32


def threshold_topk(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, lists: np.ndarray, skip: int = -1) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of a block, ties to the smaller id, and the depth read; the row ``skip`` takes no part.

    lists[d]: the rows by falling value of dimension d (read from the end where the query is negative there). The lists
    are read to a depth of DEPTH, then twice that and so on; every row met is scored in full. It stops when the bound, the
    score of a row that would stand at the depth reached in every list, is below the k-th best score, or all rows are met.
    Scores are sums of whole numbers in the vectors' own type (doubles, longs or Python's integers).
    """
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.arange(n) == skip
    rest = n - int(seen.sum())
    score = np.empty(n, vectors.dtype)
    kept = np.zeros(0, np.int64)
    depth, upto = 0, DEPTH
    while rest:
        upto = min(upto, n) if len(up) or len(down) else n
        near = np.zeros(n, bool)
        if upto == n:
            near[:] = True
        else:
            near[lists[up, depth:upto]] = True
            near[lists[down, n - upto : n - depth]] = True
        met = np.flatnonzero(near & ~seen)
        seen[met] = True
        rest -= len(met)
        score[met] = vectors[met] @ query
        kept = np.concatenate([kept, met])
        if len(kept) > k:
            kept = kept[score[kept] >= np.sort(score[kept])[-k]]
        depth, upto = upto, 2 * upto
        if len(kept) >= k and rest:
            bound = (vectors[lists[up, depth - 1], up] * query[up]).sum() + (vectors[lists[down, n - depth], down] * query[down]).sum()
            if bound < score[kept].min():
                break
    best = sorted((-int(score[i]), int(ids[i])) for i in kept)[:k]
    return [(-s, i) for s, i in best], depth


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) / 256 of every component, which doubles hold exactly however large x is.

    Rows with null ids, and null vectors or those with null or non-finite components, are left out. From 2 ** 44 on doubles are
    whole numbers of 256ths and stay as they are.
    """
    x = F.transform("embedding", lambda c: F.when(F.abs(c.cast("double")) < float(1 << 44), F.floor(256 * c.cast("double")).cast("double") / 256).otherwise(c.cast("double")))
    return rows.filter(F.col("vec_id").isNotNull()).filter(sound()).select(F.col("vec_id").cast("long"), x.alias("v"))


def as_exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 times both, in a type in which every sum of their products is exact: doubles, longs, else Python's integers."""
    with np.errstate(over="ignore"):
        most = 65536 * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return 256 * rows, 256 * queries
    if most < 1 << 62 and max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)) < float(1 << 54):
        return (256 * rows).astype(np.int64), (256 * queries).astype(np.int64)
    return integers(quantise(rows)), integers(quantise(queries))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for every row of ``queries``.

    Both hold (vec_id, v) as quantised() gives them, v being whole numbers in 256ths; scores are inner products of the whole numbers. A query's own row, one of those equal to it in id
    and vector, is not its candidate; other rows with its id are. Ties go to the smaller vec_id; with fewer than k
    candidates all are returned. A vector shorter than the longest counts as filled up with zeros. Of repeated vec_ids
    every row takes part, and every query row has a ranking of its own. Scores are exact; one among the k best that doesn't
    fit a long raises an OverflowError. The blocks of both sides bound each task's memory, whatever the number of rows, equal
    vectors or queries; every block of queries meets every block of candidates once.
    """
    ship(vectors.sparkSession)
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = queries.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    m = queries.count()
    blocks, q_blocks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(m / QUERY_ROWS))

    def cells(rows: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        hashed = F.xxhash64("vec_id", "v")
        theirs = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return rows.select("vec_id", "v", hashed.alias("hash"), F.pmod(hashed, F.lit(own)).cast("int").alias(names[0]), theirs.alias(names[1]))

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("v").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(sizes), width))
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
        return out

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            ids, hashes, q_hashes = left.column("vec_id").to_numpy(), left.column("hash").to_numpy(), right.column("hash").to_numpy()
            rows, wanted = as_exact(matrix(left), matrix(right))
            # a query's own row is in one block only, as blocks are dealt by the same hash
            own = [np.flatnonzero((hashes == h) & (ids == q))[:1] for q, h in zip(right.column("vec_id").to_numpy(), q_hashes, strict=True)]
            for at in range(0, len(ids), 2 * BLOCK_ROWS):
                some = rows[at : at + 2 * BLOCK_ROWS]
                lists = np.ascontiguousarray(np.argsort(-some, axis=0, kind="stable").T.astype(np.int32))
                for q, h, mine, query in zip(right.column("vec_id").to_pylist(), q_hashes.tolist(), own, wanted, strict=True):
                    skip = int(mine[0]) - at if len(mine) else -1
                    for s, i in threshold_topk(some, ids[at : at + 2 * BLOCK_ROWS], query, k, lists, skip)[0]:
                        if not -(1 << 63) <= s < 1 << 63:
                            raise OverflowError(f"the score of query {q} and vector {i}, {s}, doesn't fit a long")
                        found.append((q, h, i, s))
        return pa.table({name: pa.array([r[c] for r in found], pa.int64()) for c, name in enumerate(("query_id", "hash", "vec_id", "score"))})

    near = cells(vectors, blocks, q_blocks, ("block", "q_block")).groupBy("block", "q_block").cogroup(cells(asked, q_blocks, blocks, ("q_block", "block")).groupBy("block", "q_block"))
    best = near.applyInArrow(search, "query_id long, hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    ranked = best.select("query_id", "hash", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    often = asked.filter("copies > 1").select(F.col("vec_id").alias("q"), F.xxhash64("vec_id", "v").alias("h"), "copies")
    each = ranked.join(often, (F.col("query_id") == F.col("q")) & (F.col("hash") == F.col("h")), "left")
    return each.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("copies").cast("int"), F.lit(1)))).alias("copy")).drop("copy")
