import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandpiper.llm import negatives as module
from sandpiper.llm.negatives import Best, hard_negatives
from sandpiper.llm.queries import op13_hard_negatives

ROWS = "vec_id long, label int, embedding array<double>"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """Every pair, in Python's integers; rows: (vec_id, label, embedding), each of which takes part."""
    whole = [(i, y, [int(np.floor(256 * c)) for c in e]) for i, y, e in rows]
    out = Counter()
    for a, (i, y, v) in enumerate(whole):
        if not is_anchor(i):
            continue
        ranked = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j, b, z) for b, (j, z, w) in enumerate(whole) if b != a)
        for s, j, _, _ in [r for r in ranked if r[3] == y][:positives]:
            hard = [r for r in ranked if r[3] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out.update((i, j, rank, r[1], -s, -r[0]) for rank, r in enumerate(hard, 1))
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.array(r.embedding, np.float32).astype(float).tolist()) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = found(op13_hard_negatives(spark, sf_dir))
    assert got == brute(rows, lambda i: i % 100 == 0) and len(got) > 50


@pytest.mark.parametrize("seed", [1, 2])
def test_many_waves_and_blocks_with_ties_and_a_hot_vector(spark, monkeypatch, seed):
    """Blocks and waves of a few rows; a third of all rows is one vector; many scores are equal."""
    monkeypatch.setattr(module, "WAVE_BYTES", 8 * 4 * 8)
    monkeypatch.setattr(module, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(module, "CANDIDATE_ROWS", 17)
    monkeypatch.setattr(module, "LOOK", 4)
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(200)] + [(i, rng.randrange(2), [0.5] * 4) for i in range(200, 300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    assert found(hard_negatives(df, df.filter("vec_id % 10 = 0"))) == brute(rows, lambda i: i % 10 == 0)
    assert found(hard_negatives(df, df.filter("vec_id % 10 = 0"), 2, 3, 50, 120)) == brute(rows, lambda i: i % 10 == 0, 2, 3, 50, 120)


def test_repeated_rows_take_part_each(spark):
    """An anchor that stands there three times has its copies as positives, and is returned three times."""
    rows = [(0, 1, [1.0, 0.0])] * 3 + [(0, 1, [0.5, 0.5]), (0, 2, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.875, 0.0]), (2, 2, [0.875, 0.0]), (3, 2, [0.9, 0.1])]
    df = spark.createDataFrame(rows, ROWS)
    assert found(hard_negatives(df, df.filter("vec_id = 0"))) == brute(rows, lambda i: i == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(0, 1, [1.0, 0.0]), (5, 1, [0.5]), (6, 2, []), (7, 2, [0.5, 9.0]), (8, 1, [0.0, 0.0]), (100, 3, [0.25, 1.0])]
    odd = [(None, 1, [1.0, 0.0]), (1, None, [1.0, 0.0]), (2, 1, None), (3, 1, [nan, 1.0]), (4, 2, [inf, 1.0]), (200, 2, [None, 1.0])]
    df = spark.createDataFrame(sound + odd, ROWS)
    for name in ("key", "score", "rank", "copies", "wave", "twin", "copy", "anchor_id"):
        df = df.withColumn(name, F.lit("clash"))
    padded = [(i, y, [*e, 0.0, 0.0][:2]) for i, y, e in sound]
    got = hard_negatives(df, df.filter("vec_id % 100 = 0"))
    assert found(got) == brute(padded, lambda i: i % 100 == 0) and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    none = spark.createDataFrame([], ROWS)
    assert hard_negatives(none, none).count() == 0 and hard_negatives(df, none).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0])], ROWS)
    assert hard_negatives(alone, alone).count() == 0


def test_large_components_stay_exact_or_raise(spark):
    rows = [(0, 1, [1.0, 0.0, 2.0**-8]), (1, 1, [4e13, 1.0, 0.5]), (2, 1, [3e13, 0.0, 0.0]), (3, 2, [4e13, 1.0, 0.25]), (4, 2, [2.9e13, 0.0, 0.75]), (5, 2, [1e307, 0.0, 0.0])]
    df = spark.createDataFrame(rows, ROWS)
    assert found(hard_negatives(df, df.filter("vec_id = 0"))) == brute(rows[:5], lambda i: i == 0)
    with pytest.raises(OverflowError, match="doesn't fit a long"):
        hard_negatives(df, df.filter("vec_id = 1"))


def test_the_first_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 6, (5, 400)).astype(float), rng.permutation(400)
    best = Best(5, 4)
    for at in range(0, 400, 37):
        best.add(0, scores[:, at : at + 37], ids[at : at + 37], np.ones((5, len(ids[at : at + 37])), bool))
    for i in range(5):
        want = sorted(zip(-scores[i], ids, strict=True))[:4]
        assert [(-s, j) for s, j in want] == list(zip(best.score[i], best.id[i], strict=True))
