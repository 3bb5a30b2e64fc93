"""Running-mean distances and the denoising mask against sequential loops."""

import math

import numpy as np
import pytest

from floodlens.operators import model


def sequential(rows):
    """Row after row: mean so far, residual, products; then the distances."""
    n, width = 0, len(rows[0])
    total, cross = np.zeros(width), np.zeros((width, width))
    for x in rows:
        n += 1
        total += x
        rest = x - total / n
        cross += np.outer(rest, rest)
    own = np.sqrt(np.diag(cross))
    scale = np.outer(own, own)
    scale[scale == 0] = 1e-100
    return np.maximum(0, 1 - cross / scale)


@pytest.mark.parametrize("block", [1, 7, 64, 16_384])
@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_running_distances(spark, block, shift):
    rng = np.random.default_rng(block)
    x = np.cumsum(rng.normal(size=(60, 4)), axis=0) + shift
    x[:, 3] = 5.0  # constant features have no correlation
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_no long, vector array<double>").repartition(5)
    got = {(r.i, r.j): r.distance for r in model.running_distances(frame, block_rows=block).collect()}
    want = sequential(x)
    assert set(got) == {(i, j) for i in range(4) for j in range(i + 1, 4)}
    assert all(math.isclose(v, want[k], rel_tol=1e-6, abs_tol=1e-6) for k, v in got.items())


def test_running_distances_of_awkward_rows(spark):
    schema = "row_no long, vector array<double>, block long, x int"
    rows = [(0, [1.0, 2.0], 1, 1), (None, [9.0, 9.0], 1, 1), (1, None, 1, 1), (2, [2.0, 1.0], 1, 1)]
    got, = model.running_distances(spark.createDataFrame(rows, schema)).collect()
    assert math.isclose(got.distance, sequential(np.array([[1.0, 2.0], [2.0, 1.0]]))[0, 1])
    assert model.running_distances(spark.createDataFrame([], schema)).count() == 0


def test_mask():
    rows, features = np.arange(2000), np.arange(10)
    mask = model.corruption_mask(rows, 3, features, 0.3, 7)
    assert abs(mask.mean() - 0.7) < 0.02 and (abs(mask.mean(0) - 0.7) < 0.05).all()
    assert (mask[::-1] == model.corruption_mask(rows[::-1], 3, features, 0.3, 7)).all()
    assert (mask[:, 4] == model.corruption_mask(rows, 3, np.array([4]), 0.3, 7)[:, 0]).all()
    assert (mask != model.corruption_mask(rows, 4, features, 0.3, 7)).any()


def test_denoising_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.random(6).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "row_no long, vector array<double>")
    fits = [model.ensemble_fit(f, [[0, 1, 2], [3, 4, 5]], rounds=4, corruption=c).orderBy("layer", "grp").collect()
            for f, c in ((frame.coalesce(1), 0.3), (frame.repartition(7), 0.3), (frame.coalesce(1), 0.0))]
    weights = [np.concatenate([r.w for r in fit]) for fit in fits]
    assert np.allclose(weights[0], weights[1], rtol=1e-9, atol=1e-9)
    assert not np.allclose(weights[0], weights[2], atol=1e-4)
