import numpy as np
import pytest

from floodlens.llm.whitening import chebyshev_subspace, whiten


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows],
                                 "vec_id bigint, embedding array<float>, label int, n int, whitened double").repartition(3)


def brute(rows, k=4):
    """By the full covariance matrix, with exact deviations."""
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    wide = max({len(x) for _, x in rows}, key=lambda w: (sum(len(x) == w for _, x in rows), w))
    rows = [(i, x) for i, x in rows if len(x) == wide]
    fit = np.unique(np.stack([x for _, x in rows]), axis=0)
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(wide, wide))
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in rows:
        for c in range(min(k, wide, int((values > values[0] * 1e-10).sum()))):
            out.setdefault((i, c + 1), []).append((
                n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, sums)), abs((x - sums / n) @ axes[:, c]) / np.sqrt(values[c]),
                values[c] / values.sum()))
    return out


def awkward(rng, width, n, spread=0.1):
    rows = [(i, rng.normal(0, spread, width).astype(np.float32).tolist()) for i in range(n)]
    rows += [(i + n, rows[i % 5][1]) for i in range(20)]
    return rows + [(9001, None), (9002, [None] + [0.5] * (width - 1)), (9003, [float("nan")] * width), (9004, []), (9005, [1.0] * (width + 1)),
                   (9006, [float("inf")] + [0.0] * (width - 1)), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("width, n", [(12, 300), (40, 500), (2, 30), (1, 9)])
def test_against_full_matrix(spark, width, n):
    rows = awkward(np.random.default_rng(width), width, n)
    got = whiten(frame(spark, rows)).collect()
    want = brute(rows)
    seen, signs = {}, {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in seen.items()} == {k: len(v) for k, v in want.items()}
    for key, mine in seen.items():
        for r, (size, deviation, white, part) in zip(mine, want[key]):
            assert (r.n, r.deviation) == (size, deviation)
            assert abs(abs(r.whitened) - white) < 1e-8 and abs(r.explained - part) < 1e-10 and r.identity_error < 1e-9
    fit = {tuple(np.floor(256 * np.array(v, np.float32))): i for i, v in rows[:n]}
    white = np.array([[next(r.whitened for r in seen[i, c] if True) for c in range(1, min(4, width) + 1)] for i in fit.values()])
    assert np.abs(white.T @ white / len(white) - np.eye(min(4, width))).max() < 1e-8


def test_little_variance(spark):
    one = [(i, [0.5, 0.25, 0.125]) for i in range(4)]
    assert whiten(frame(spark, one)).count() == 0
    line = [(i, [i / 16, i / 8, 0.5]) for i in range(30)]
    got = whiten(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and max(r.identity_error for r in got) < 1e-9
    assert whiten(frame(spark, line).where("false")).count() == 0


def test_large_values(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=5) * 1e12).tolist()) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whiten(table).collect()
    assert all(r.deviation is None for r in got) and max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("spectrum", [
    np.linspace(1.02, 1, 64), np.r_[1e6, 10, 5, 1.001, np.ones(60)], np.r_[1, 1e-3, 1e-6, 1e-9, np.zeros(60)],
    np.r_[[2.0] * 3, np.linspace(1, 0.5, 61)]])
def test_spectra(spectrum):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    matrix = (basis * spectrum) @ basis.T
    passes = []
    values, axes = chebyshev_subspace(lambda q: passes.append(1) or matrix @ q, 64, 4)
    assert np.abs(values - np.sort(spectrum)[::-1][:4]).max() < 1e-11 * spectrum.max()
    assert np.linalg.norm(matrix @ axes - axes * values) < 1e-10 * spectrum.max() and len(passes) < 400


def test_a_start_that_misses_the_largest():
    """The first block is orthogonal to the leading direction; the columns drawn anew find it."""
    matrix = np.diag(np.r_[5.0, np.linspace(2, 1, 63)])
    first = []

    def times(q):
        if not first:
            first.append(1)
            q[0] = 0
        return matrix @ q

    assert abs(chebyshev_subspace(times, 64, 4)[0][0] - 5) < 1e-12
