import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sandpiper.llm.queries import op9_toxicity
from sandpiper.llm.toxicity import features, ftrl, toxicity

from .helpers import docs, odd_docs, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, sf)
    assert got.count() == 10_000
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert len(toxic) > 50
    pairs = [(a > b) + 0.5 * (a == b) for a in toxic for b in clean]
    assert sum(pairs) / len(pairs) > 0.97
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.01
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.7


def test_features_are_words_pairs_and_skips():
    found, first = features([b"One two,THREE", b"", b"one one"])
    assert np.diff(first).tolist() == [6, 0, 2]


def test_weights_are_sparse():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(60, 5000, 80)) for _ in range(1500)]
    labels = (np.arange(1500) % 5 == 0).astype(float)
    rows = [np.append(r, i % 50) if i % 5 == 0 else r for i, r in enumerate(rows)]
    bias, at, value = ftrl(rows, labels, 13)
    assert 0 < len(at) < 1500 and at[np.argmax(value)] < 60 and bias < 0


def test_odd_rows(spark):
    rows = with_clashes(odd_docs(spark))
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, None), (4, None, 0), (4, 1, 1), (None, 1, 1), (99, 1, 1), (6, 0, 0)], LABELS)
    got = toxicity(rows, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity(rows, none).collect()} == {0.5}
    assert toxicity(docs(spark, []), labels).count() == 0


def plain_features(text, bits):
    """Words, neighbours and pairs with one word between them, hashed, by a loop over characters."""
    words, word = [], b""
    for c in text.lower().encode() + b" ":
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            words.append(word)
            word = b""
    m = (1 << 64) - 1

    def spread(h):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor & m
        return h ^ h >> 31

    hashes = [spread((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, m + 1) for i, b in enumerate(x)) + len(x)) & m) for x in words]
    kinds = list(hashes)
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x27D4EB2F165667C5)):
        kinds += [spread((a * salt + b) & m) for a, b in zip(hashes, hashes[gap:], strict=False)]
    return sorted({k >> 64 - bits for k in kinds})


def test_weights_and_scores_against_a_plain_loop(spark):
    """FTRL-proximal as published, coordinate by coordinate, and the scores it gives."""
    bits, alpha, beta, l1, l2 = 12, 1.0, 1.0, 6.0, 1.0
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k}" for k in range(80)] + ["vile", "nasty"]
    texts = [" ".join(rng.choice(vocabulary[:80], 30)) + (" you vile nasty thing" if k % 3 == 0 else "") for k in range(200)]
    labels = [int(k % 3 == 0) for k in range(200)]
    known = [k for k in range(200) if crc32(str(k).encode()) % 5]
    x = {k: plain_features(texts[k], bits) for k in range(200)}
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    z0 = n0 = 0.0
    order = np.random.default_rng(9)
    for _ in range(3):
        for at in order.permutation(len(known)):
            k = known[at]
            w, w0 = {i: weight(i) for i in x[k]}, -z0 / ((beta + n0**0.5) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + w0))) - labels[k]
            for i in x[k]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
            n0 += g * g
    bias = -z0 / ((beta + n0**0.5) / alpha)
    table = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)], LABELS)
    got = toxicity(docs(spark, texts), table, bits=bits).collect()
    assert len(got) == 200 and any(weight(i) for i in z)
    for r in got:
        assert r.score == pytest.approx(1 / (1 + math.exp(-(bias + sum(weight(i) for i in x[r.doc_id])))), abs=1e-5)
