import math

import numpy as np
import pytest

from floodlens.llm import range_join
from floodlens.llm.range_join import cells_of, near_vectors


def brute(rows, cosine=0.98):
    good = {k: np.array(v, float) for k, (i, v, la) in enumerate(rows)
            if i is not None and la is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root = {i: i for i, *_ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                    root[y] = x
    out = []
    for n, (i, _, _) in zip(links, rows):
        c = None if i is None else find(i) if any(rows[k][0] == i for k in good) else i
        out.append((i, n, c, c == i))
    return sorted(out, key=str)


def cloud(rng, n, width=6):
    """Loose vectors, tight groups with members on both sides of the bound, copies and chains."""
    rows = [(i, rng.normal(size=width), i % 3) for i in range(n)]
    for g in range(6):
        middle = rng.normal(size=width)
        rows += [(1000 * (g + 1) + i, middle + rng.normal(0, 0.12 + 0.03 * g, width), g % 2) for i in range(40)]
    angle = np.arange(50) * 0.15
    rows += [(8000 + i, np.r_[np.cos(a), np.sin(a), np.zeros(width - 2)], 1) for i, a in enumerate(angle)]
    rows = [(i, v.astype(np.float32).tolist(), la) for i, v, la in rows]
    copies = [(9000 + i, rows[n][1], 0) for i in range(30)] + [(9100 + i, rows[2][1], 2) for i in range(5)]
    odd = [(7001, None, 1), (7002, [0.0] * width, 1), (7003, [None] + rows[0][1][1:], 1), (7004, [float("nan")] * width, 1),
           (7005, [float("inf")] + rows[0][1][1:], 1), (7006, [], 1), (7007, rows[0][1], None), (None, rows[0][1], 0),
           (7008, rows[0][1][:3], 0), (7009, rows[0][1][:3], 0), (3, rows[3][1], 0), (3, rows[5][1], 2), (4, rows[4][1], 1),
           (7010, [-0.0, 0.0, 1.0, 0.0, 0.0, 0.0], 1), (7011, [0.0, 0.0, 2.0, 0.0, -0.0, 0.0], 1), (7012, [1e-30] * width, 2), (7013, [1e30] * width, 2)]
    return rows + copies + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 5, 6) for i, v, la in rows],
                                 "vec_id bigint, embedding array<float>, label int, cell string, home int, component int").repartition(3)


@pytest.mark.parametrize("cell_rows, task_rows, pivots", [(1024, 8192, 64), (20, 64, 64), (10, 16, 3)])
def test_against_all_pairs(spark, monkeypatch, cell_rows, task_rows, pivots):
    monkeypatch.setattr(range_join, "PIVOTS", pivots)
    rows = cloud(np.random.default_rng(cell_rows), 200)
    got = near_vectors(frame(spark, rows), cell_rows=cell_rows, task_rows=task_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert near_vectors(frame(spark, rows).where("false")).count() == 0


def test_cells_hold_all_neighbours():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    x = np.concatenate([x, x + rng.normal(0, 0.05, x.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots, radius = x[rng.choice(800, 12)], math.sqrt(0.04)
    nearest, may = cells_of(x, pivots, radius)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= radius
    for q in range(12):
        need = near[:, nearest == q].any(axis=1)
        assert not (need & ~may[:, q]).any()
    assert may.mean() < 0.6


def test_a_tight_group_needs_no_pairs(spark):
    """What leaves the tasks follows the vectors, not their pairs."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    rows = [(i, (middle + rng.normal(0, 0.02, 16)).tolist(), 1) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    made = []
    plain = range_join.joined
    try:
        range_join.joined = lambda *a: made.append(plain(*a)) or made[-1]
        got = near_vectors(table, cell_rows=100, task_rows=200).collect()
    finally:
        range_join.joined = plain
    assert {r.n_links for r in got} == {599} and {r.component_id for r in got} == {0}
    assert sum(m.count() for m in made) < 600 * 3 + 6 * 3 * 300
