"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandpiper.llm.tokens import U, binary, mix, parcels, split_words
from sandpiper.session import cut, ship

BITS = 18
RANK = 8
#: Labelled documents that are learnt from at most, those with the smallest hash of doc_id.
TRAIN_ROWS = 8_000
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LINES = np.ones(256, bool)
_LINES[10] = False
#: Kinds of bytes: small letters and all beyond ASCII, capitals, digits, symbols, other marks, white space.
_KIND = np.full(256, 4, np.uint8)
for _k, _bytes in enumerate(([*range(97, 123), *range(128, 256)], range(65, 91), range(48, 58), b"#*$%&|<>", (), b" \t\n\v\f\r")):
    _KIND[list(_bytes)] = _k
STATISTICS = ("bytes", "words", "lines", "small", "capitals", "digits", "symbols", "marks", "white", "word_length", "distinct_words", "top_word", "same_as_last", "marked_ends", "distinct_lines", "line_words", "ended_lines", "declared", "as_declared")


def _log(x: np.ndarray) -> np.ndarray:
    """Steps of half a power of two."""
    return np.floor(2 * np.log2(1 + np.maximum(x, 0))).astype(np.int64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Steps of a share: finer near zero, as rare things are told apart best."""
    return np.floor(24 * np.sqrt(part / np.maximum(whole, 1))).astype(np.int64)


def statistics(texts: list[bytes], declared: np.ndarray) -> np.ndarray:
    """The step of every statistic (columns as in STATISTICS) of every text; declared: the stated number of characters, -1 where unknown."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    words, lines = split_words(texts), split_words(texts, _LINES)
    kind = _KIND[words.buf]
    runs = np.zeros(len(kind) + 1, np.int64)

    def count(found: np.ndarray) -> np.ndarray:
        np.cumsum(found, out=runs[1:])
        return runs[start[1:] - 1] - runs[start[:-1]]  # without the line end that joins the texts

    kinds = [count(kind == k) for k in range(6)]
    chars = count((words.buf & 0xC0) != 0x80)
    n_words, n_lines = np.diff(words.first), np.diff(lines.first)

    def of_each(found: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(found)])
        return total[first[1:]] - total[first[:-1]]

    def distinct(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of each text, and how often its most frequent one stands."""
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, own[at], np.diff(np.append(at, len(h))))
        return np.bincount(own[at], minlength=n), top

    h, own, ends = words.hashes(), words.doc_of(), words.buf[words.ends - 1] if len(words.ends) else words.buf[:0]
    different, top = distinct(h, own)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    lines_differ, _ = distinct(lines.hashes(), lines.doc_of())
    line_ends = lines.buf[lines.ends - 1] if len(lines.ends) else lines.buf[:0]
    return np.stack([
        _log(size), _log(n_words), _log(n_lines), *(_share(k, size) for k in kinds), _log(size / np.maximum(n_words, 1)), _share(different, n_words), _share(top, n_words), _share(of_each(again, words.first), n_words),
        _share(of_each(np.isin(_KIND[ends], (3, 4)), words.first), n_words), _share(lines_differ, n_lines), _log(n_words / np.maximum(n_lines, 1)), _share(of_each(np.isin(line_ends, list(b".!?:;")), lines.first), n_lines),
        np.where(declared < 0, -1, _log(declared)), (declared == chars).astype(np.int64),
    ], axis=1)


def features(texts: list[bytes], declared: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, first of each text), places rising within a text.

    Words (runs of letters and digits, A-Z lower-cased, each once) share a length of 1 between them; every step of a statistic has a place of its own
    and a share of a length of 1 as well. What meets in a place is added up.
    """
    n = len(texts)
    words = split_words([t.lower() for t in texts], _LETTERS)
    own, place = words.doc_of(), (words.hashes() >> U(64 - bits)).astype(np.int64)
    said = np.unique(own << bits | place)
    often = np.bincount(said >> bits, minlength=n)
    steps = statistics(texts, declared)
    salted = mix((np.arange(len(STATISTICS), dtype=U) << U(32))[None, :] + (steps + 2).astype(U) + U(0x51ED270B7F2C4A35))
    numbers = (np.arange(n)[:, None] << bits | (salted >> U(64 - bits)).astype(np.int64)).ravel()
    keys = np.concatenate([said, numbers])
    value = np.concatenate([1 / np.sqrt(often[said >> bits]), np.full(len(numbers), len(STATISTICS) ** -0.5)])
    both, at = np.unique(keys, return_inverse=True)
    return both & (1 << bits) - 1, np.bincount(at, value, len(both)), np.searchsorted(both, np.arange(n + 1) << bits)


def machine(bias: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> float:
    """bias + sum of w x + the sum over pairs of <v_i, v_j> x_i x_j, in time linear in the features: half of (sum of v x) ** 2 less the sum of (v x) ** 2."""
    p = v * x[:, None]
    return bias + w @ x + 0.5 * float((p.sum(0) ** 2).sum() - (p * p).sum())


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, rank: int = RANK, rate: float = 0.15, l2: float = 1e-4, epochs: int = 5) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Bias, places seen, their weights and factors: logistic loss, a step of AdaGrad for each document (Rendle 2010; Duchi et al. 2011)."""
    random = np.random.default_rng(12)
    used = np.unique(np.concatenate([r[0] for r in rows])) if rows else np.zeros(0, np.int64)
    w, v = np.zeros(len(used)), random.normal(0, 0.1, (len(used), rank))
    gw, gv, bias, gb = np.full(len(used), 1e-2), np.full((len(used), rank), 1e-2), 0.0, 1e-2
    rows = [(np.searchsorted(used, at), x) for at, x in rows]
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, x = rows[i]
            wi, vi = w[at], v[at]
            p = vi * x[:, None]
            total = p.sum(0)
            raw = bias + wi @ x + 0.5 * float((total**2).sum() - (p * p).sum())
            g = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[i]
            dw = g * x + l2 * wi
            dv = g * x[:, None] * (total - p) + l2 * vi
            gw[at] += dw * dw
            gv[at] += dv * dv
            w[at] = wi - rate * dw / np.sqrt(gw[at])
            v[at] = vi - rate * dv / np.sqrt(gv[at])
            gb += g * g
            bias -= rate * g / gb**0.5
    return float(bias), used, w, v


def scores(model: tuple[float, np.ndarray, np.ndarray], places: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities of texts from dense weights and factors."""
    bias, w, v = model

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return total[first[1:]] - total[first[:-1]]

    p = v[places] * values[:, None]
    raw = bias + sums(w[places] * values) + 0.5 * ((sums(p) ** 2).sum(1) - sums((p * p).sum(1)))
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def held_out() -> Column:
    """Rows whose labels are never learnt from: crc32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _given(docs: DataFrame) -> DataFrame:
    """What a score is made of: the text, and the stated number of characters where there is such a column."""
    stated = F.expr("try_cast(n_chars AS BIGINT)") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(stated, F.lit(-1)).alias("declared"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, bits: int = BITS, rank: int = RANK) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """A machine learnt from labelled documents that are not held out, at most most_rows of them, in one task.

    Of several labels of a document the lower counts; of rows that share a doc_id the least text is learnt from. Without any
    labelled document there are no weights.
    """
    spark = ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("quality"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select(F.col("doc_id").cast("long").alias("l_id"), "quality"))
    rows = _given(docs)
    texts = rows.join(F.broadcast(chosen), rows.doc_id == F.col("l_id")).groupBy("l_id", "quality").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "declared")).alias("one")).select("l_id", "quality", "one.*")

    def hashed(batches):
        for batch in parcels(batches):
            at, x, first = features(binary(batch, "text"), batch.column("declared").to_numpy(), bits)
            ends = list(zip(first[:-1], first[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("quality"), pa.array([at[a:b].astype("<u4").tobytes() for a, b in ends], pa.binary()), pa.array([x[a:b].astype("<f4").tobytes() for a, b in ends], pa.binary())], names=["l_id", "quality", "at", "x"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("l_id")
        given = [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for a, x in zip(rows["at"], rows.x, strict=True)]
        bias, used, w, v = learn(given, rows.quality.to_numpy(float), bits, rank)
        return pd.DataFrame({"bias": [bias], "at": [used.astype("<u4").tobytes()], "w": [w.astype("<f4").tobytes()], "v": [v.astype("<f4").tobytes()]})

    made = texts.mapInArrow(hashed, "l_id long, quality int, at binary, x binary").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "bias double, at binary, w binary, v binary").first()
    if made is None:
        return 0.0, np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, rank), np.float32)
    return made.bias, np.frombuffer(made["at"], "<u4").astype(np.int64), np.frombuffer(made.w, "<f4"), np.frombuffer(made.v, "<f4").reshape(-1, rank)


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, bits: int = BITS, rank: int = RANK) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier), predicted (1 if score >= 0.5) for every document.

    A score uses the whole text and n_chars, the stated number of characters (null, missing or no number: unknown), nothing else. The machine is learnt from
    a bounded sample (see train) and broadcast: at most 2 ** bits places with rank + 1 numbers each. Words never learnt weigh nothing. Null
    and empty texts are judged by what statistics say of them; without labels all scores are 0.5. One row for each input row;
    a null doc_id is not held out. A text is held in memory by the task that reads it, with some 100 bytes a character. Other columns are not read.
    """
    bias, used, w, v = train(docs, labels, most_rows, bits, rank)
    model = docs.sparkSession.sparkContext.broadcast((bias, used, w, v))

    def run(batches):
        bias, used, w, v = model.value
        dense_w, dense_v = np.zeros(1 << bits), np.zeros((1 << bits, rank))
        dense_w[used], dense_v[used] = w, v
        for batch in parcels(batches, most_bytes=1 << 20):
            found = features(binary(batch, "text"), batch.column("declared").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores((bias, dense_w, dense_v), *found))], names=["doc_id", "score"])

    scored = _given(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
