import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sandpiper.llm.queries import op3_exact_topk
from sandpiper.llm.topk import DEPTH, quantised, threshold_topk, topk

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, each=50):
    v = {i: np.floor(256 * np.array(e, np.float32).astype(np.float64)).astype(np.int64) for i, e in rows}
    out = set()
    for q in v:
        if q % each == 0:
            ranked = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)}
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op3_exact_topk(spark, sf_dir).collect()} == brute(rows)


def test_many_blocks_with_ties(spark, monkeypatch):
    from sandpiper.llm import topk as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    monkeypatch.setattr(module, "QUERY_ROWS", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(4)], 0) for i in range(400)] + [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(400, 600)]
    v = quantised(spark.createDataFrame(rows, ROWS))
    got = {tuple(r) for r in topk(v, v.filter("vec_id % 50 = 0")).collect()}
    assert got == brute([r[:2] for r in rows])


def test_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(0)
    vectors = rng.integers(0, 10, (5000, 3))
    vectors[:10] = 200
    lists = np.argsort(-vectors, axis=0, kind="stable").T
    got, depth = threshold_topk(vectors, np.arange(5000), np.array([1, 2, 0]), 5, lists, 0)
    assert got == [(600, i) for i in range(1, 6)] and depth == DEPTH
    vectors[:10] = 0
    assert threshold_topk(vectors, np.arange(5000), np.array([1, 2, -3]), 5, np.argsort(-vectors, axis=0, kind="stable").T, 0)[1] > DEPTH


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, None), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [0.5], 1), (6, [], 1), (None, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1)]
    df = quantised(spark.createDataFrame(rows, ROWS).selectExpr("*", "'clash' as v", "1 as block", "2 as score"))
    got = [tuple(r) for r in topk(df, df.filter("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 65536), (0, 2, 7, 65536), (0, 3, 5, 32768), (0, 4, 6, 0)]
    none = quantised(spark.createDataFrame([], ROWS))
    assert topk(none, none).count() == 0


def test_large_components_stay_exact_or_raise(spark):
    rows = [(0, [1.0, 0.0, 2.0**-8]), (1, [4e13, 1.0, 0.5]), (2, [3e13, 0.0, 0.0]), (3, [4e13, 1.0, 0.75]), (4, [-4e13, 2e10, 1.0]), (5, [0.0, 0.0, 0.0])]
    v = quantised(spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, label int"))
    got = [tuple(r) for r in topk(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    whole = {i: [math.floor(256 * Fraction(x)) for x in e] for i, e in rows}
    ranked = sorted((-sum(a * b for a, b in zip(whole[0], w, strict=True)), i) for i, w in whole.items() if i)
    assert got == [(0, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk(v, v.filter("vec_id = 3"), 1).collect()
    big = quantised(spark.createDataFrame([(0, [2e10], 0), (1, [2e10], 0)], ROWS))
    with pytest.raises(Exception, match="OverflowError"):
        topk(big, big.filter("vec_id = 0")).collect()


def test_every_finite_double_takes_part(spark):
    """Components that overflow when multiplied by 256 rank as they should; a score that fits no long is named."""
    rows = [(0, [0.0, 1.0]), (1, [1e307, 2.0]), (2, [-1.7e308, 3.0]), (3, [5e-324, -1e-300])]
    v = quantised(spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, label int"))
    got = [tuple(r) for r in topk(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 3 * 65536), (0, 2, 1, 2 * 65536), (0, 3, 3, -256)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk(v, v.filter("vec_id = 1")).collect()


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (7, [0.5, 0.5], 0), (7, [0.5, 0.5], 0)]
    v = quantised(spark.createDataFrame(rows, ROWS))
    got = sorted(tuple(r) for r in topk(v, v.filter("vec_id % 50 = 0"), 2).collect())
    # each of the two equal query rows sees the other; the third sees those of id 7 first
    assert got == sorted([(50, 1, 50, 65536), (50, 2, 7, 32768)] * 2 + [(50, 1, 7, 32768), (50, 2, 7, 32768)])
