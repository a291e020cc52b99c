"""Hard negatives: dense products of broadcast anchor blocks with candidate blocks, in two passes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandpiper.llm.vectors import EXACT, matrix, products, quantise, sound
from sandpiper.session import cut, ship

#: Bytes of anchors, as doubles, that one wave broadcasts; they bound the driver's and each task's share of the model.
WAVE_BYTES = 32 << 20
#: Anchors and candidates of one dense product.
ANCHOR_ROWS = 1024
CANDIDATE_ROWS = 2048
#: One candidate in so many is met first, to give every anchor a bound that its other candidates have to reach.
LOOK = 64
_MOST = (1 << 63) - 1


class Best:
    """The first k entries (by falling score, then rising id) of each of m keys, met in blocks; mergeable, as the first k of
    several parts' first k are those of the whole.

    floor: (score, id) for each key; entries behind it are not kept. Scores are doubles, or Python's integers once some need it.
    """

    def __init__(self, m: int, k: int, floor: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.k = k
        self.score = np.full((m, k), -np.inf)
        self.id = np.full((m, k), _MOST)
        self.twin = np.zeros((m, k), bool)
        self.bar, self.bar_id = floor or (np.full(m, -np.inf), np.full(m, _MOST))

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, twin: np.ndarray | None = None) -> None:
        """scores[i, j]: of key at + i and candidate j, which counts where wanted."""
        own = slice(at, at + len(scores))
        bar, bar_id = self.bar[own, None], self.bar_id[own, None]
        if scores.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        near = wanted & (scores >= bar)
        near &= (scores > bar) | (ids <= bar_id)
        n = scores.shape[1]
        if n > self.k and np.count_nonzero(near) > 4 * self.k * len(scores) and scores.dtype != object:
            near &= scores >= np.partition(np.where(near, scores, -np.inf), n - self.k, axis=1)[:, n - self.k, None]
        key, col = np.nonzero(near)
        if not len(key):
            return
        touched = np.unique(key)
        of = np.concatenate([np.repeat(touched, self.k), key])
        score = np.concatenate([self.score[at + touched].ravel(), scores[key, col]])
        found = np.concatenate([self.id[at + touched].ravel(), ids[col]])
        twins = np.concatenate([self.twin[at + touched].ravel(), twin[key, col] if twin is not None else np.zeros(len(key), bool)])
        order = np.lexsort((found, np.negative(score), of)) if score.dtype != object else np.array(sorted(range(len(of)), key=lambda i: (of[i], -score[i], found[i])))
        first = np.searchsorted(of[order], touched)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[at + touched] = score[take].reshape(-1, self.k)
        self.id[at + touched] = found[take].reshape(-1, self.k)
        self.twin[at + touched] = twins[take].reshape(-1, self.k)
        last = self.score[at + touched, -1]
        full = touched[last > -np.inf]
        if self.score.dtype == object and self.bar.dtype != object:
            self.bar = self.bar.astype(object)
        self.bar[at + full], self.bar_id[at + full] = self.score[at + full, -1], self.id[at + full, -1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, id, score, twin); a score beyond a long stands at the end of the longs."""
        key, col = np.nonzero(self.score > -np.inf)
        score = self.score[key, col]
        return key, self.id[key, col], np.array([max(-_MOST, min(_MOST, int(s))) for s in score], np.int64), self.twin[key, col]


def _numbers(values: list[int]) -> np.ndarray:
    """Doubles if they hold all of them exactly, else Python's integers."""
    return np.array(values, np.float64 if all(abs(v) < EXACT for v in values) else object)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Both tables hold (vec_id, label, embedding), the anchors are rows of ``vectors``. Components become floor(256 * x); a score
    is the inner product of whole numbers, exact; higher scores come first, ties by smaller vec_id. An anchor's positives
    are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score are returned; where there are fewer, all are. Rows with a null vec_id or label, or a vector
    that is null or holds null or non-finite components, take no part. A shorter vector counts as filled up with zeros.
    Of repeated rows each takes part: an anchor leaves out one row equal to it, and is itself returned as often as it stands there.
    A positive's score beyond a long raises an error. Empty tables give no rows; other columns are not read.

    Anchors go in waves of WAVE_BYTES: a wave is broadcast, every candidate is multiplied with it where it lies, and a task keeps the
    first few of each anchor; only these are shuffled. A first look at one candidate in LOOK gives each anchor a bound, so
    that what tasks send doesn't grow with their number. The second pass does the same for the windows below the positives.
    """
    spark = ship(vectors.sparkSession)

    def clean(rows: DataFrame) -> DataFrame:
        return rows.filter("vec_id is not null and label is not null").filter(sound()).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")

    rows, asked = clean(vectors), clean(anchors).groupBy("vec_id", "label", "embedding").agg(F.count("*").alias("copies"))
    width = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    asked = cut(asked)
    wave_rows = max(1, WAVE_BYTES // (8 * max(1, width)))
    waves = -(-asked.count() // wave_rows)
    dealt = asked.withColumn("wave", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(max(1, waves))))
    found = [_wave(rows, dealt.filter(F.col("wave") == w).drop("wave").toArrow(), width, positives, negatives, low, high) for w in range(waves)]
    found = [f for f in found if f is not None]
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], kind)


def _wave(rows: DataFrame, table: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    """The negatives of one wave of anchors."""
    if not table.num_rows:
        return None
    spark, k = rows.sparkSession, positives + 1  # its own row may stand among the first of an anchor
    ids, labels, copies = (table.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
    shared = spark.sparkContext.broadcast((ids, labels, matrix(table.column("embedding"), width)))
    m = len(ids)

    def blocks(batches):
        """(first anchor, its slice, candidate ids, their labels, scores, twins) of all pairs of blocks."""
        a_ids, a_labels, raw = shared.value
        whole = quantise(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(at, CANDIDATE_ROWS)
                c_ids, c_labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                c_rows = matrix(part.column("embedding"), width)
                values = quantise(c_rows)
                for a in range(0, m, ANCHOR_ROWS):
                    own = slice(a, a + ANCHOR_ROWS)
                    twin = a_ids[own, None] == c_ids
                    for i, j in zip(*np.nonzero(twin), strict=True):
                        twin[i, j] = a_labels[a + i] == c_labels[j] and (raw[a + i] == c_rows[j]).all()
                    yield a, own, c_ids, a_labels[own, None] == c_labels, products(whole[own], values), twin

    def nearest(floor):
        def run(batches):
            best = Best(m, k, floor and floor.value)
            for a, _, c_ids, same, scores, twin in blocks(batches):
                best.add(a, scores, c_ids, same, twin)
            key, vec_id, score, twins = best.entries()
            yield pa.RecordBatch.from_pydict({"key": key, "vec_id": vec_id, "score": score, "twin": twins})

        return lambda source: source.mapInArrow(run, "key long, vec_id long, score long, twin boolean")

    def first(parts: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    def bounds(parts: DataFrame, keys: int, most: int):
        """The last of the first ``most`` that a first look found for each key."""
        got = first(parts, most).filter(F.col("rank") == most).select("key", "vec_id", "score").toArrow()
        bar, bar_id = [-np.inf] * keys, np.full(keys, _MOST)
        for key, vec_id, score in zip(*(got.column(c).to_pylist() for c in ("key", "vec_id", "score")), strict=True):
            if abs(score) < _MOST:
                bar[key], bar_id[key] = score, vec_id
        kept = np.array(bar, object) if any(abs(b) >= EXACT for b in bar if b != -np.inf) else np.array(bar, np.float64)
        return spark.sparkContext.broadcast((kept, bar_id))

    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(LOOK)) == 0)
    got = first(nearest(bounds(nearest(None)(some), m, k))(rows), k).toPandas().sort_values(["key", "rank"], kind="stable")
    itself = got.twin & ~got[got.twin].duplicated("key").reindex(got.index, fill_value=True)
    got = got[~itself]
    got = got[got.groupby("key").cumcount() < positives]
    if (got.score.abs() >= _MOST).any():
        bad = got[got.score.abs() >= _MOST].iloc[0]
        raise OverflowError(f"the score of anchor {ids[bad.key]} and positive {bad.vec_id} doesn't fit a long")
    p = len(got)
    if not p:
        return None
    of, p_ids, p_scores = got.key.to_numpy(), got.vec_id.to_numpy(), got.score.to_numpy()
    least, most = _numbers([-(-low * int(s) // 100) for s in p_scores]), _numbers([high * int(s) // 100 for s in p_scores])
    first_of = np.searchsorted(of, np.arange(m + 1))
    wanted = spark.sparkContext.broadcast((of, p_ids, p_scores, least, most, first_of, copies))

    def window(floor):
        def run(batches):
            of, p_ids, p_scores, least, most, first_of, copies = wanted.value
            a_ids = shared.value[0]
            best = Best(p, negatives, floor and floor.value)
            for a, own, c_ids, same, scores, _ in blocks(batches):
                at, end = first_of[a], first_of[min(own.stop, m)]
                step = max(1, ANCHOR_ROWS)
                for b in range(at, end, step):
                    e = min(end, b + step)
                    line = of[b:e] - a
                    s = scores[line]
                    best.add(b, s, c_ids, ~same[line] & (s >= least[b:e, None]) & (s <= most[b:e, None]))
            key, vec_id, score, _ = best.entries()
            yield pa.RecordBatch.from_pydict({"key": key, "vec_id": vec_id, "score": score, "anchor_id": a_ids[of[key]], "positive_id": p_ids[key], "positive_score": p_scores[key], "copies": copies[of[key]]})

        return lambda source: source.mapInArrow(run, "key long, vec_id long, score long, anchor_id long, positive_id long, positive_score long, copies long")

    near = first(window(bounds(window(None)(some), p, negatives))(rows), negatives)
    each = near.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return cut(each.drop("copy"))
