"""Whitening against a dense eigendecomposition, and the cases its docstring defines."""

import numpy as np
import pytest

from foliospark.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def dense(vectors):
    """Sums of squares, whitened rows and shares of the variance from the covariance itself."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    y = (n * x - total) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return ((n * x - total) ** 2).sum(1), y @ v[:, :8] / np.sqrt(e[:8]), e[:8] / e.sum()


@pytest.mark.parametrize(("n", "d"), [(500, 12), (300, 9), (7, 3), (40, 1)])
def test_equals_dense(spark, n, d):
    draw = np.random.default_rng(n)
    vectors = (draw.normal(size=(n, d)) * np.linspace(0.3, 3, d) + 5).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    squares, whitened, explained = dense(vectors)
    k = min(8, d)
    assert len(found) == n * k and set(found["n"]) == {n}
    for _, g in found.groupby("vec_id"):
        at = g["vec_id"].iloc[0]
        g = g.sort_values("component")
        assert set(g["deviation"]) == {squares[at]}
        np.testing.assert_allclose(np.abs(g["whitened"]), np.abs(whitened[at]), atol=1e-9)
        np.testing.assert_allclose(g["explained"], explained, rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_one_sign_for_all_rows(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(200, 8)).astype(np.float32)
    found = whitening.whiten(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], SCHEMA)).toPandas()
    _, whitened, _ = dense(vectors)
    own = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    np.testing.assert_allclose(np.abs((own * whitened).sum(0)), (whitened**2).sum(0), rtol=1e-9)


def test_jacobi_keeps_small_values():
    """Singular values ten orders apart: those of the product of rows would be lost."""
    draw = np.random.default_rng(2)
    u, _ = np.linalg.qr(draw.normal(size=(30, 6)))
    v, _ = np.linalg.qr(draw.normal(size=(6, 6)))
    sizes = 10.0 ** -np.arange(0, 12, 2)
    lengths, axes = whitening.jacobi(np.linalg.qr((u * sizes) @ v.T, mode="r"))
    np.testing.assert_allclose(lengths, sizes, rtol=1e-5)
    np.testing.assert_allclose(np.abs((axes * v).sum(0)), 1, rtol=1e-9)


def test_tree_of_many_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(150, 5)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], SCHEMA).repartition(11)
    found = whitening.whiten(rows).filter("vec_id = 3").orderBy("component").toPandas()
    np.testing.assert_allclose(np.abs(found["whitened"]), np.abs(dense(vectors)[1][3]), atol=1e-9)


def test_left_out_rows_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(1, [0.0, 1.0]), (2, [2.0, 0.5]), (2, [2.0, 0.5]), (None, [1.0, 3.0])]
    dropped = [(5, None), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [-inf, 0.0]), (10, []), (11, [1.0, 2.0, 3.0])]
    found = whitening.whiten(spark.createDataFrame(kept + dropped, SCHEMA)).toPandas()
    assert len(found) == 8 and set(found["n"]) == {4}
    assert sorted(found["vec_id"].dropna()) == [1, 1, 2, 2, 2, 2] and found["vec_id"].isna().sum() == 2


def test_no_variance_no_rows_and_rank(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(6)], SCHEMA)).toPandas()
    assert set(line["component"]) == {1} and line["explained"].iloc[0] == pytest.approx(1)


def test_clashing_columns_and_many_copies(spark):
    rows = [(k, [1.0, 2.0], 1, 2) for k in range(300)] + [(k, [float(k % 7), float(k % 5)], 1, 2) for k in range(150)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA + ", x int, n int")).toPandas()
    assert len(found) == 900 and found["identity_error"].iloc[0] < 1e-9


def test_deviation_beyond_64_bits_is_an_error():
    with pytest.raises(OverflowError):
        whitening._squares(np.array([[2**62, 2**62]]))
    assert whitening._squares(np.array([[3_000_000_000, 0], [2, 1]])).tolist() == [9 * 10**18, 5]
