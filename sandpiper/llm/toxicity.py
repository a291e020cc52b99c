"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandpiper.llm.tokens import U, binary, mix, parcels, split_words
from sandpiper.session import cut, ship

BITS = 20
#: Labelled documents that are learnt from at most, those with the smallest hash of doc_id; the rest of them is not needed.
TRAIN_ROWS = 8_000
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed features of every text: (features, first of each text).

    Words are runs of letters and digits, A-Z lower-cased. Features: words, pairs of neighbours, and pairs that skip a word.
    """
    words = split_words([t.lower() for t in texts], _LETTERS)
    h = words.hashes()
    own = words.doc_of()
    kinds = [(h, own)]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x27D4EB2F165667C5)):
        if len(h) > gap:
            inside = own[:-gap] == own[gap:]
            kinds.append((mix(h[:-gap] * U(salt) + h[gap:])[inside], own[:-gap][inside]))
    every = np.concatenate([k for k, _ in kinds]) >> U(64 - bits)
    of = np.concatenate([o for _, o in kinds]).astype(U)
    both = np.unique((of << U(bits)) | every)
    first = np.searchsorted(both, np.arange(len(texts) + 1, dtype=U) << U(bits))
    return (both & U((1 << bits) - 1)).astype(np.int64), first


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, places and values of the weights that are not zero (McMahan et al. 2013).

    Every coordinate has its own learning rate; L1 keeps the weights few. The bias is not regularised.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(9)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            w = weight(z[x], n[x])
            w0 = -z0 / ((beta + n0**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - labels[i]
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha * w
            n[x] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
            n0 += g * g
    w = weight(z, n)
    used = np.flatnonzero(w)
    return float(-z0 / ((beta + n0**0.5) / alpha)), used, w[used].astype(np.float32)


def held_out():
    """Rows whose labels are never learnt from: crc32 of the id's digits divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights learnt from labelled documents that are not held out, at most most_rows of them, in one task.

    Several labels of a document count as toxic if one is; of rows that share a doc_id one text is learnt from.
    Without any labelled document all weights are zero.
    """
    spark = ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select(F.col("doc_id").cast("long").alias("l_id"), "toxic"))
    rows = docs.select("doc_id", "text")
    texts = rows.join(F.broadcast(chosen), rows.doc_id == F.col("l_id")).groupBy("l_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def hashed(batches):
        for batch in parcels(batches):
            found, first = features(binary(batch, "text"), bits)
            rows = [found[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["l_id", "toxic", "x"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("l_id")
        bias, at, value = ftrl([np.frombuffer(x, "<u4") for x in rows.x], rows.toxic.to_numpy(float), bits)
        return pd.DataFrame({"bias": [bias], "at": [at.astype("<u4").tobytes()], "value": [value.astype("<f4").tobytes()]})

    made = texts.mapInArrow(hashed, "l_id long, toxic int, x binary").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "bias double, at binary, value binary").first()
    if made is None:
        return 0.0, np.zeros(0, np.int64), np.zeros(0, np.float32)
    return made.bias, np.frombuffer(made["at"], "<u4").astype(np.int64), np.frombuffer(made.value, "<f4")


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for every document.

    A score uses the whole text and nothing else. The weights are learnt from a bounded sample (see train) and shipped
    with the task: at most 2 ** bits, few in practice. Null and empty texts get the score of the bias. One row for each input
    row; a null doc_id is not held out. Other columns are not read.
    """
    bias, at, value = train(docs, labels, most_rows, bits)
    model = docs.sparkSession.sparkContext.broadcast((bias, at, value))

    def run(batches):
        b, places, values = model.value
        w = np.zeros(1 << bits, np.float32)
        w[places] = values
        for batch in parcels(batches):
            found, first = features(binary(batch, "text"), bits)
            sums = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
            score = 1 / (1 + np.exp(-np.clip(sums[first[1:]] - sums[first[:-1]] + b, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
