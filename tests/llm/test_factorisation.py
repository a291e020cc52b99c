from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandpiper.llm.factorisation import BITS, STATISTICS, features, learn, machine, quality, scores, statistics
from sandpiper.llm.queries import op12_quality_classifier

from .helpers import docs, odd_docs, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op12_quality_classifier(spark, sf)
    assert got.count() == 10_000
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert len(bad) > 100
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.99
    assert sum(s < 0.5 for s in good) / len(good) < 0.01 and sum(s >= 0.5 for s in bad) / len(bad) < 0.05


def test_labels_lang_source_and_ids_are_no_inputs(spark):
    """Same texts under other ids, languages and sources get the same scores; only rows that aren't held out teach."""
    texts = [f"plain words number {k} here" if k % 2 else "### @@ $$$ " * (k + 1) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], LABELS)
    rows = docs(spark, texts)
    moved = rows.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("other"))
    one = {r.doc_id: r.score for r in quality(rows, labels).collect()}
    assert one == {r.doc_id: r.score for r in quality(moved, labels).collect()}
    flipped = labels.withColumn("quality", F.expr("CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END"))
    assert one == {r.doc_id: r.score for r in quality(rows, flipped).collect()}


def plain_score(bias, w, v, at, x):
    """All pairs, one by one."""
    raw = bias + sum(w[i] * a for i, a in zip(at, x, strict=True))
    for j in range(len(at)):
        for k in range(j + 1, len(at)):
            raw += sum(v[at[j]][f] * v[at[k]][f] for f in range(v.shape[1])) * x[j] * x[k]
    return 1 / (1 + np.exp(-raw))


def test_pairs_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(7)
    bits = 6
    w, v = rng.normal(size=1 << bits), rng.normal(size=(1 << bits, 3))
    lists = [np.sort(rng.choice(1 << bits, k, replace=False)) for k in (0, 1, 2, 17)]
    values = [rng.random(len(at)) for at in lists]
    first = np.concatenate([[0], np.cumsum([len(at) for at in lists])])
    got = scores((0.3, w, v), np.concatenate(lists).astype(int), np.concatenate(values), first)
    for at, x, s in zip(lists, values, got, strict=True):
        assert s == pytest.approx(plain_score(0.3, w, v, at, x))
        raw = machine(0.3, w[at], v[at], x)
        assert s == pytest.approx(1 / (1 + np.exp(-raw)))


def test_a_pair_is_learnt_that_no_single_feature_shows():
    """Good exactly if one of two features is there without the other: only their interaction tells."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        at = np.array([0 + a, 2 + b])
        rows.append((at, np.ones(2)))
        labels.append(float(a != b))
    bias, used, w, v = learn(rows, np.array(labels), 3, 4)
    for a in (0, 1):
        for b in (0, 1):
            at = np.searchsorted(used, [a, 2 + b])
            assert (machine(bias, w[at], v[at], np.ones(2)) > 0) == (a != b)


def test_statistics_of_plain_texts():
    texts = [b"One two two.\nOne two two.\n", b"", "Ünï ###".encode()]
    got = {name: column.tolist() for name, column in zip(STATISTICS, statistics(texts, np.array([26, -1, 7])).T, strict=True)}
    share = lambda part, whole: int(24 * (part / whole) ** 0.5)
    assert got["as_declared"] == [1, 0, 1] and got["declared"][1] == -1
    assert got["distinct_words"] == [share(3, 6), 0, 24] and got["same_as_last"][0] == 0
    assert got["distinct_lines"] == [share(1, 2), 0, 24] and got["ended_lines"] == [24, 0, 0]
    assert got["symbols"] == [0, 0, share(3, 9)] and got["capitals"][0] == share(2, 26)
    at, x, first = features(texts, np.array([26, -1, 7]))
    assert len(first) == 4 and first[-1] == len(at) and (at < 1 << BITS).all() and (x > 0).all()


def test_odd_rows(spark):
    rows = with_clashes(odd_docs(spark)).withColumn("declared", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 1), (3, None, 0), (4, 0, None), (4, 1, 1), (None, 1, 1), (99, 1, 1), (6, 1, 0), (5, 0, 0)], LABELS)
    got = quality(rows, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id is None and not r.held_out for r in got) == 1
    assert {r.score for r in quality(rows, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality(docs(spark, []), labels).count() == 0
    for other in (rows.drop("n_chars"), rows.withColumn("n_chars", F.lit("many"))):
        assert quality(other, labels).count() == 10
