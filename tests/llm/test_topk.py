import numpy as np
from pyspark.sql import functions as F

from floodlens.llm.topk import SlicedBlock, top_k


def brute(rows, k, query=lambda i: i % 5 == 0):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    asked = {}
    for i, v in whole:
        if query(i):
            asked[i] = min((len(v), v), asked.get(i, (len(v), v)))
    for q, (n, v) in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == n)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.4, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 330)]                   # ties
    rows += [(330, None), (335, [1.0, None] * 4), (340, [float("nan")] * 8), (345, [float("inf")] * 8), (None, rows[0][1]),
             (350, []), (355, [0.5, -0.25]), (356, [0.5, 1.0]), (10, rows[10][1]), (360, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, block int")
    for size in (16_384, 37):
        got = top_k(frame, F.col("vec_id") % 5 == 0, block_rows=size, query_rows=20)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    assert top_k(frame.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_slices():
    rng = np.random.default_rng(1)
    values = rng.integers(-300, 300, (130, 5))
    block = SlicedBlock(np.arange(130), values)
    for query in (values[3], np.zeros(5, int), -values[7]):
        ids, scores = block.top(query, 200)
        assert len(ids) == 130 and (scores == values[ids] @ query).all()
        want = np.lexsort((np.arange(130), -(values @ query)))[:9]
        assert sorted(block.top(query, 9)[0].tolist()) == sorted(want.tolist())
