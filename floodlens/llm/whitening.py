"""Whitening of vectors by a Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. Each distinct vector is stored once, in packed blocks; one pass over them multiplies
the centred table with a thin block of columns, forth and back. A recurrence of such passes is a Chebyshev polynomial of
the covariance that damps the part of the spectrum below the block's smallest Ritz value, and grows fast above. After each
filter the block is orthonormalised (QR) and rotated to its Ritz vectors, until the residuals certify the wanted ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.llm.common import arrow_schema
from floodlens.session import cut

BLOCK = 4096
#: Passes of one filter, at most, and the growth of a filter, at which rounding would mix its columns.
DEGREE, GROWTH = 16, 1e12
#: Residual, as a part of the largest eigenvalue, that certifies; and the one accepted once rounding stops progress.
CERTIFIED, ROUNDED = 2e-14, 1e-11
KINDS = (np.int8, np.int16, np.int32, np.int64)


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column, scale: float) -> Column:
    """Not null, not empty, all entries finite and their scaled values exact as doubles."""
    most = float(2 ** 53) / scale
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < most))


def packed(distinct: DataFrame, width: int) -> DataFrame:
    """(rows, kind, data, sums): blocks of vectors in the smallest integers that hold them, and their sums per dimension."""
    schema = arrow_schema("rows bigint, kind int, top bigint, data binary, sums array<string>")

    def run(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(flat), BLOCK):
                x = flat[at:at + BLOCK]
                top = int(max(x.max(), -int(x.min())))
                kind = next(k for k, t in enumerate(KINDS) if top <= np.iinfo(t).max)
                exact = x.sum(axis=0) if top < 2 ** 50 else x.astype(object).sum(axis=0)
                yield pa.RecordBatch.from_pylist([{
                    "rows": len(x), "kind": kind, "top": top, "data": np.ascontiguousarray(x.astype(KINDS[kind])).tobytes(),
                    "sums": [str(s) for s in exact]}], schema=schema)

    return distinct.mapInArrow(run, "rows bigint, kind int, top bigint, data binary, sums array<string>")


class FitList:
    """The stored distinct vectors: their number, exact sums, and products with their centred covariance."""

    def __init__(self, vectors: DataFrame, width: int):
        self.width = width
        self.blocks = cut(packed(vectors, width))
        head = self.blocks.agg(F.sum("rows"), F.max("top")).first()
        self.n, self.top = int(head[0] or 0), int(head[1] or 0)
        sums = (self.blocks.select(F.posexplode("sums").alias("k", "s"))
                .groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        self.sums = [0] * width
        for row in sums:
            self.sums[row["k"]] = int(row["s"])
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(width)

    def total(self, of) -> np.ndarray:
        """The sum of ``of(centred block)`` over all blocks; tasks add up their own first."""
        mean, width = self.mean, self.width

        def run(batches):
            total = None
            for batch in batches:
                for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = of(np.frombuffer(data, KINDS[kind]).reshape(-1, width) - mean)
                    total = part if total is None else total + part
            if total is not None:
                flat = np.asarray(total, float).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                                 names=["k", "v"])

        rows = (self.blocks.select("kind", "data").mapInArrow(run, "k int, v double")
                .groupBy("k").agg(F.sum("v").alias("v")).collect())
        out = np.zeros(len(rows))
        for row in rows:
            out[row["k"]] = row["v"]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times a thin matrix."""
        return self.total(lambda x: x.T @ (x @ q)).reshape(q.shape) / self.n


def chebyshev_subspace(times, width: int, k: int, block: int | None = None, seed: int = 11, most: int = 60):
    """The ``k`` largest eigenvalues and unit eigenvectors of a positive semidefinite matrix given by its products.

    The last column of the block is drawn anew in each round, so that no start can hide a direction for good.
    """
    rng = np.random.default_rng(seed)
    k = min(k, width)
    size = min(width, block or 6 * k)
    q = np.linalg.qr(rng.normal(size=(width, size)))[0]
    aq = times(q)
    last = math.inf
    for _ in range(most):
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        rest = np.linalg.norm(aq - q * values, axis=0)
        worst = rest[:k].max()
        if values[0] <= 0 or worst <= CERTIFIED * values[0] or (worst <= ROUNDED * values[0] and worst > last / 2):
            return np.maximum(values[:k], 0), q[:, :k]
        last = worst
        # certified leading columns are kept out of the filter, which would blow up what rounding leaves of them
        fixed = int(np.argmax(rest > CERTIFIED * values[0]))
        held, top = q[:, :fixed], values[fixed]
        bound = values[-2 if size < width and size > k + 1 else -1]
        if bound <= top * 1e-13:  # the block holds the whole range but for rounding
            y = aq[:, fixed:]
        else:
            centre = half = bound / 2
            grow = math.acosh(max(1.0, (top - centre) / half))
            degree = max(1, min(DEGREE, int(math.log(GROWTH) / grow) if grow else DEGREE))
            before, y = q[:, fixed:], (aq[:, fixed:] - centre * q[:, fixed:]) / half
            for _ in range(degree - 1):
                y -= held @ (held.T @ y)
                before, y = y, 2 * (times(y) - centre * y) / half - before
        if size < width:
            y[:, -1] = rng.normal(size=width)
        y -= held @ (held.T @ y)
        q = np.linalg.qr(np.hstack([held, y / np.maximum(np.linalg.norm(y, axis=0), 1e-300)]))[0]
        aq = times(q)
    raise ArithmeticError(f"the eigenvectors did not settle in {most} rounds")


def whiten(vectors: DataFrame, k: int = 4, scale: float = 256.0, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """Whitened coordinates: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry). All statistics are those of the distinct x vectors, ``n`` in number.
    ``deviation`` is the exact sum over the dimensions of (n x - S)^2, null where 64 bits do not hold it. ``whitened`` is
    the centred vector's coordinate on the component over the root of its eigenvalue, ``explained`` the eigenvalue's part of
    the trace, ``identity_error`` how far the covariance of ``whitened`` is from the identity. The sign of a component
    is that of its largest entry.

    Vectors that are null, empty, or hold null or non-finite entries (or such whose x exceeds 2^53) drop out, and so do
    vectors of another width than the most frequent one (equally frequent: the widest). Null ids stay; repeated rows are
    one vector of the fit list and a row each. Components without variance are left out, so a table of one distinct
    vector, like an empty one, gives no rows. Other columns are ignored.
    """
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    column = F.col(vector_column)
    good = vectors.where(usable(column, scale)).select(F.col(id_column).cast("long").alias("id"), quantised(column, scale).alias("x"))
    widths = good.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    named = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if widths is None:
        return vectors.sparkSession.createDataFrame([], schema).toDF(*named)
    width = widths["w"]
    good = good.where(F.size("x") == width)
    fit = FitList(good.select("x").distinct(), width)
    values, axes = chebyshev_subspace(fit.times, width, k)
    held = values > values[0] * 1e-12 * width
    values, axes = values[held], axes[:, held]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    basis = axes / np.sqrt(values)
    found = len(values)
    if not found:
        return vectors.sparkSession.createDataFrame([], schema).toDF(*named)
    trace = float(fit.total(lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0]) / fit.n
    spread = fit.total(lambda x: (x @ basis).T @ (x @ basis)).reshape(found, found) / fit.n
    middle = fit.total(lambda x: (x @ basis).sum(axis=0)) / fit.n
    error = float(np.abs(spread - np.outer(middle, middle) - np.eye(found)).max())
    n, sums, explained = fit.n, fit.sums, values / trace
    small = width * (n * fit.top + max(map(abs, sums))) ** 2 < 2 ** 63
    out = arrow_schema(schema)

    def run(batches):
        exact = np.array(sums, np.int64 if small else object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            off = n * (x if small else x.astype(object)) - exact
            squares = (off * off).sum(axis=1)
            deviation = pa.array([v if v < 2 ** 63 else None for v in squares.tolist()], pa.int64())
            white = (off.astype(float) / n) @ basis
            rows = len(x)
            back = pa.array(np.repeat(np.arange(rows), found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(back), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * found, n, np.int64)), deviation.take(back), pa.array(white.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * found, error))], schema=out)

    return good.mapInArrow(run, schema).toDF(*named)
