import numpy as np
import pytest
from pyspark.sql import functions as F

from sandpiper.llm import whitening as module
from sandpiper.llm.queries import op11_embedding_whitening
from sandpiper.llm.whitening import fit, jacobi, whiten

ROWS = "vec_id long, embedding array<double>"


def reference(x):
    """Components by eigenvectors of the covariance, in numpy."""
    each = np.unique(x, axis=0)
    n, sums = len(each), each.sum(0)
    z = each - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()


def compared(got, ids, x):
    n, deviation, whitened, explained = reference(x)
    assert (got.n == n).all() and len(got) == 4 * len(ids)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((wide * whitened).sum(0))
    np.testing.assert_allclose(wide * sign, whitened, atol=1e-9)
    one = got.drop_duplicates("vec_id").set_index("vec_id").loc[ids]
    assert [int(v) for v in one.deviation] == deviation.tolist()
    np.testing.assert_allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_whole_table_against_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(rows.embedding).astype(float)).astype(np.int64)
    got = op11_embedding_whitening(spark, sf_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compared(got.toPandas(), rows.vec_id.to_list(), x)


def test_distinct_vectors_are_fitted_once_over_many_factors(spark, monkeypatch):
    """A hot vector, repeats, and a reduction of several levels."""
    monkeypatch.setattr(module, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-300, 300, (400, 7)) * [9, 5, 3, 1, 1, 1, 1], np.full((300, 7), 17), rng.integers(-2, 2, (100, 7))])
    x = np.concatenate([x, x[:50]])
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], ROWS).repartition(13)
    compared(whiten(df).toPandas(), list(range(len(x))), x)


@pytest.mark.parametrize("shape", [(40, 30), (31, 31), (9, 20), (50, 1), (1, 1), (0, 3)])
def test_jacobi_against_numpy(shape):
    a = np.random.default_rng(5).normal(size=shape) * 10.0 ** np.random.default_rng(6).integers(-8, 3, shape[1])
    lengths, v = jacobi(a)
    want = np.concatenate([np.linalg.svd(a, compute_uv=False), np.zeros(max(0, shape[1] - shape[0]))])
    np.testing.assert_allclose(lengths, want, rtol=1e-9, atol=1e-12 * max(want, default=1))
    np.testing.assert_allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(a @ v, axis=0), lengths, rtol=1e-9, atol=1e-12 * max(want, default=1))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(0, [1.0, 0.0]), (1, [0.5]), (2, []), (3, [-0.0, 2.0]), (3, [-0.0, 2.0]), (None, [1.0, 1.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame([*sound, (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0])], ROWS)
    for name in ("x", "n", "pos", "total", "component", "whitened"):
        df = df.withColumn(name, F.lit("clash"))
    got = whiten(df).toPandas()
    assert len(got) == 2 * len(sound) and got.vec_id.isna().sum() == 2 and (got.n == 5).all() and got.identity_error.max() < 1e-12
    assert np.allclose(got.groupby("component").explained.first().sum(), 1)
    for rows in ([], [(0, None)], [(0, []), (1, [])], [(0, [1.0, 2.0])] * 3):
        assert whiten(spark.createDataFrame(rows, ROWS)).count() == 0


def test_large_components_and_little_variance(spark):
    """Sums and deviations stay exact beyond longs; a component without variance gives no rows."""
    values = [2.0**40, 2.0**41, -(2.0**42), 1e300]
    x = [int(256 * v) for v in values[:3]] + [(1 << 63) - 1]
    got = whiten(spark.createDataFrame([(i, [v, 7.0]) for i, v in enumerate(values)], ROWS)).toPandas()
    assert got.component.tolist() == [1] * 4 and got.identity_error.max() < 1e-9
    want = [(4 * v - sum(x)) ** 2 for v in x]
    assert {r.vec_id: r.deviation if r.deviation is None else int(r.deviation) for r in got.itertuples()} == {i: v if v < 10**38 else None for i, v in enumerate(want)}


def test_model_grows_with_the_width_only(spark):
    learnt = fit(spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)], ROWS), 2)
    assert learnt.n == 15 and learnt.components.shape == (3, 2) and learnt.deviations[0] >= learnt.deviations[1] > 0
