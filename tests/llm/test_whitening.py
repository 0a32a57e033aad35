"""Whitening against a full eigenvalue decomposition."""

import numpy as np
import pytest

from airloom.llm.queries import QUERIES
from airloom.llm.whitening import bidiagonal, fit_whitening, whiten, whole_rows


def whole(vectors):
    return np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)


def frame_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 7, 1, 2.0) for i, v in zip(ids, vectors)],
                                 "vec_id long, embedding array<float>, label int, component int, whitened double")


def check(spark, vectors, components=32):
    """Against numpy on the same whole numbers; returns the fit."""
    x = whole(np.float32(vectors))
    rows, fitted, error = whiten(frame_of(spark, [[float(c) for c in v] for v in vectors]), components)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    count = min(components, int((values > 1e-12 * values[0]).sum()))
    assert fitted.n == n and fitted.sums.tolist() == sums.tolist() and len(fitted.values) == count
    assert np.allclose(fitted.values, values[:count], rtol=1e-11, atol=1e-12 * values[0])
    assert np.abs(cov @ fitted.axes - fitted.axes * fitted.values).max() < 1e-12 * values[0]
    assert np.abs(fitted.axes.T @ fitted.axes - np.eye(count)).max() < 1e-12
    assert np.isclose(fitted.trace, np.trace(cov), rtol=1e-12) and error < 1e-8
    found = {r["vec_id"]: r for r in rows.collect()}
    assert len(found) == n
    white = centred @ (fitted.axes / np.sqrt(fitted.values))
    for i in range(n):
        assert int(found[i]["deviation"]) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert np.allclose(found[i]["whitened"], white[i], rtol=0, atol=1e-9)
    assert abs(np.abs(np.array([r["whitened"] for r in found.values()]).T @ np.array([r["whitened"] for r in found.values()]) / n
                      - np.eye(count)).max() - error) < 1e-9
    return fitted


@pytest.mark.parametrize("size,rows", [(64, 300), (1, 20), (3, 50), (40, 12), (33, 400)])
def test_components_of_random_vectors(spark, size, rows):
    draw = np.random.default_rng(size)
    check(spark, draw.normal(size=(rows, size)) * np.linspace(0.2, 3, size) + draw.normal(size=size) * 5)


def test_equal_variances_and_constant_directions(spark):
    corners = [np.eye(6)[i] * s for i in range(4) for s in (1, -1)] * 3
    fitted = check(spark, corners)
    assert len(fitted.values) == 4 and np.ptp(fitted.values) < 1e-9
    check(spark, [v.tolist() for v in np.repeat(np.eye(5), [3, 4, 5, 6, 7], axis=0)], components=2)


def test_early_end_of_many_dimensions():
    draw = np.random.default_rng(2)
    turn, _ = np.linalg.qr(draw.normal(size=(400, 400)))
    x = draw.normal(size=(900, 400)) * np.concatenate([np.geomspace(400, 40, 10), np.full(390, 0.5)]) @ turn
    deviations, axes, steps = bidiagonal(lambda w: x.T @ (x @ w), 400, 10)
    full = np.linalg.svd(x)
    assert steps < 200 and np.allclose(deviations, full[1][:10], rtol=1e-13)
    assert np.allclose(np.abs((full[2][:10] * axes.T).sum(1)), 1, atol=1e-12)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], None, [], [None, 1.0], [inf, 1.0], [nan, 0.0], [1e30, 1.0], [1.0, 2.0, 3.0],
               [0.5, 0.25]]
    rows, fitted, error = whiten(frame_of(spark, vectors, [0, 0, None, 3, 4, 5, 6, 7, 8, 9, 10]))
    assert sorted((str(r["vec_id"]) for r in rows.collect())) == ["0", "0", "10", "None"]
    assert fitted.n == 4 and len(fitted.values) == 2 and error < 1e-9
    same, fitted, error = whiten(frame_of(spark, [[1.0, 2.0]] * 3))
    assert [r["whitened"] for r in same.collect()] == [[]] * 3 and fitted.n == 3 and error == 0
    none, fitted, error = whiten(frame_of(spark, vectors).where("false"))
    assert none.count() == 0 and fitted is None and error == 0


def test_deviations_beyond_a_long_are_exact(spark):
    rows, fitted, _ = whiten(frame_of(spark, [[2.0 ** 40], [-(2.0 ** 40)], [0.0]]))
    assert {int(r["deviation"]) for r in rows.collect()} == {(3 * 2 ** 46) ** 2, 0}
    assert fit_whitening(whole_rows(frame_of(spark, [[0.0]]))).trace == 0


def test_the_query_on_the_given_vectors(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    found = QUERIES["op11_embedding_whitening"](spark, folder).toPandas()
    x = whole(given["embedding"])
    n, sums = len(x), x.sum(0)
    cov = ((n * x - sums) / n).T @ ((n * x - sums) / n) / n
    values = np.linalg.eigvalsh(cov)[::-1][:32]
    assert len(found) == n * 32 and (found["n"] == n).all() and found["identity_error"].nunique() == 1
    assert found["identity_error"].iloc[0] < 1e-4
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    assert np.abs(wide.T @ wide / n - np.eye(32)).max() < 1e-4
    shares = found.groupby("component")["explained"].first().sort_index().to_numpy()
    assert np.allclose(shares, values / np.trace(cov), rtol=1e-9)
    deviation = found.groupby("vec_id")["deviation"].first().loc[given["vec_id"]].to_numpy()
    assert deviation.tolist() == np.square(n * x - sums).sum(1).tolist()
