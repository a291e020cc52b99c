"""Whitening of embeddings: blockwise TSQR of the centred rows, then a one-sided Jacobi SVD of the small factor R."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandpiper.llm.vectors import integers, matrix, quantise, sound
from sandpiper.session import cut, remove, shared_dir, ship

#: Factors that one task of the reduction stacks.
FAN_IN = 32
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """What a fit has learnt: n distinct rows, their sums, unit components (columns), standard deviations, shares of the variance."""

    width: int
    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: longs where those hold every value, else Python's integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max([0, *(abs(s) for s in self.sums)])
        if most <= _LONG and x.dtype != object:
            return x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return integers(x) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / max(1, self.n) @ self.components / self.deviations


def longs(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x) as longs; what is beyond them stands at their end."""
    x = quantise(rows)
    if x.dtype == object:
        return np.vectorize(lambda v: max(-_LONG - 1, min(_LONG, v)), otypes=[np.int64])(x)
    return x.astype(np.int64)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the orthogonalised columns of r, falling, and the accumulated rotations (columns in that order).

    One-sided Jacobi (Hestenes): plane rotations make two columns at a time orthogonal until all are; r @ v has orthogonal columns, so
    v holds the right singular vectors and the lengths are the singular values. A round takes disjoint pairs (the
    circle method), so that it is one array operation.
    """
    d = r.shape[1]
    tolerance = max(1, d) ** 0.5 * np.finfo(float).eps
    largest = np.abs(r).max(initial=0) or 1.0
    a = np.array(r, np.float64).T / largest  # columns as rows, which are contiguous
    v = np.eye(d)
    if d > 1:
        ring = np.arange(d + d % 2)  # with an odd number of columns one rests in each round
        for _ in range(sweeps):
            off = 0.0
            for _ in range(len(ring) - 1):
                p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
                real = (p < d) & (q < d)
                p, q = p[real], q[real]
                x, y = a[p], a[q]
                xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
                scale = np.sqrt(xx) * np.sqrt(yy)
                turn = (np.abs(xy) > tolerance * scale) & (scale > 1e-40)  # shorter columns are nothing but rounding
                off = max(off, (np.abs(xy[turn]) / scale[turn]).max(initial=0))
                if turn.any():
                    p, q, x, y, xx, yy, xy = p[turn], q[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
                    with np.errstate(over="ignore"):
                        zeta = (yy - xx) / (2 * xy)
                        t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                    c = 1 / np.hypot(1, t)
                    s = c * t
                    for m in (a, v):
                        x, y = m[p], m[q]
                        m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
                ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if off <= tolerance:
                break
    lengths = np.sqrt((a * a).sum(1))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order] * largest, v[order].T


def _columns(batches, width: int, name: str = "x"):
    for batch in batches:
        yield batch, matrix(batch.column(name), width)


def _factor(width: int, rows_of):
    """A task's rows to the rows of its factor R; what a task holds is R and one block."""

    def run(batches):
        r = np.zeros((0, width))
        for batch in batches:
            rows = rows_of(batch)
            for at in range(0, len(rows), max(1024, 2 * width)):
                r = np.linalg.qr(np.vstack([r, rows[at : at + max(1024, 2 * width)]]), mode="r")
        for at in range(0, len(r), 256):
            some = r[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, width), pa.int32()), pa.array(some.ravel()))], names=["x"])

    return run


def _totals(parts: DataFrame, columns: list[str]) -> list:
    return parts.groupBy("pos").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("pos").collect()


def fit(vectors: DataFrame, most: int = 4) -> Whitening:
    """Learn from each distinct vector of ``embedding`` once (as whole numbers floor(256 * c)).

    The distinct vectors are written to the shared folder and read three times: sums; TSQR of the centred rows, whose
    factors are stacked and factored again, FAN_IN at a time, until one of at most width rows is left; and the covariance of what whitening gives.
    Only sums and that factor reach the driver: they grow with the width, not with the rows. Components without variance (beyond
    rounding) are left out, so there may be fewer than ``most``, or none.
    """
    spark = ship(vectors.sparkSession)
    width = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]

    def whole(batches):
        for batch in batches:
            x = longs(matrix(batch.column("embedding"), width))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, width))[: len(x) + 1] if width else np.zeros(len(x) + 1), pa.int32()), pa.array(x.ravel(), pa.int64()))], names=["x"])

    home = f"{shared_dir(spark)}/whitening-{uuid4().hex}"
    vectors.select("embedding").mapInArrow(whole, "x array<bigint>").distinct().write.parquet(home)
    try:
        return _fit(spark, spark.read.parquet(home), width, most)
    finally:
        remove(spark, home)


def _fit(spark: SparkSession, rows: DataFrame, width: int, most: int) -> Whitening:
    def sums(batches):
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _exact(batch.column("x"), width)
            safe = int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 1 << 62
            n, total = n + len(x), total + integers((x if safe else x.astype(object)).sum(0))
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "total": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))})

    got = _totals(rows.mapInArrow(sums, "pos int, n long, total decimal(38,0)"), ["n", "total"]) if width else []
    n = int(got[0].n) if got else 0
    if not n:
        return Whitening(width, n, [0] * width, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    learnt = Whitening(width, n, [int(r.total) for r in got], np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    level = cut(rows.mapInArrow(_factor(width, lambda batch: learnt.centred(_exact(batch.column("x"), width)).astype(np.float64) / n), "x array<double>"))
    while (left := level.count()) > width:
        level = cut(level.repartition(-(-left // (FAN_IN * width))).mapInArrow(_factor(width, lambda batch: matrix(batch.column("x"), width)), "x array<double>"))
    lengths, turned = jacobi(np.array([r.x for r in level.collect()]).reshape(-1, width))
    kept = min(most, int((lengths > lengths.max(initial=0) * width * np.finfo(float).eps).sum()))
    learnt.components, learnt.deviations = turned[:, :kept], lengths[:kept] / np.sqrt(n)
    learnt.explained = lengths[:kept] ** 2 / (lengths**2).sum() if kept else lengths[:kept]
    learnt.identity_error = _identity_error(spark, rows, learnt)
    return learnt


def _exact(column, width: int) -> np.ndarray:
    """A column of longs, all of one width, as they are."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _identity_error(spark: SparkSession, rows: DataFrame, learnt: Whitening) -> float:
    """The largest entry of the covariance of the whitened rows, centred, less the identity."""
    k = len(learnt.deviations)
    if not k:
        return 0.0
    known = spark.sparkContext.broadcast(learnt)

    def moments(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            w = known.value.whitened(known.value.centred(_exact(batch.column("x"), learnt.width)))
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(total)), pa.int32()), "total": pa.array(total)})

    total = np.array([r.total for r in _totals(rows.mapInArrow(moments, "pos int, total double"), ["total"])]) / learnt.n
    mean = total[:k]  # the rows are centred already, so the means are nothing but rounding and the product takes no digits away
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error: a row for each sound row
    of (vec_id, embedding) and each of the first ``most`` components.

    Components c become the whole numbers x = floor(256 * c); those beyond a long stand at its end. n counts the distinct x vectors, all else
    is learnt from these (divisor n). deviation is the sum of (n * x - sums) ** 2 over dimensions, exact, as decimal(38, 0), null where it has
    more digits. whitened is the centred row on the component over the component's standard deviation; explained its share of
    the whole variance; identity_error the largest entry of the whitened covariance less the identity. Rows whose vector is null or holds
    null or non-finite components are left out; a shorter one counts as filled up with zeros. A null vec_id stays null; repeated rows are
    each returned. Components without variance give no rows, so one distinct vector, empty vectors and an empty table give none.
    Of equal variances any basis may come. Other columns are not read.
    """
    rows = vectors.filter(sound()).select(F.col("vec_id").cast("long"), "embedding")
    learnt = fit(rows, most)
    known = rows.sparkSession.sparkContext.broadcast(learnt)
    k, width = len(learnt.deviations), learnt.width

    def run(batches):
        if not k:
            return
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                centred = known.value.centred(longs(matrix(part.column("embedding"), width)))
                largest = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
                if centred.dtype != object and largest * largest * width <= _LONG:
                    deviation = pa.array((centred * centred).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (centred.astype(object) ** 2).sum(1)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                w = known.value.whitened(centred)
                again = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(again), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), "n": pa.array(np.full(len(again), known.value.n)), "deviation": deviation.take(again),
                    "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(known.value.explained, part.num_rows)), "identity_error": pa.array(np.full(len(again), known.value.identity_error)),
                })

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
