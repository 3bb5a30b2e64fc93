"""Anomaly model on feature vectors: feature grouping, autoencoders, scoring.

Vectors come as ``(row_no, vector)``. Statistics, learning and scoring all run over whole tables:
tasks reduce their rows to matrices of the size of the features, and those are added up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from floodlens.session import cut

# Learning defaults and the weight seed.
MAX_GROUP = 10
ROUNDS = 20
LEARNING_RATE = 0.05
HIDDEN_RATIO = 0.75
WEIGHT_SEED = 1234
FLOOR = 1e-16
TINY = 1e-100
#: Rows of a block of running means.
RUN_ROWS = 16_384

MODEL_SCHEMA = ("layer int, grp int, members array<int>, w array<double>, hidden array<double>, "
                "visible array<double>, low array<double>, high array<double>")


# --- correlation and grouping --------------------------------------------------------

def co_moments(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Per task and feature pair: rows, both means and the centred sum of products.

    Values are taken relative to one vector of the table, and each task folds its Arrow
    batches into one centred n x n matrix, so large means do not cancel the products out.
    """
    some = vectors.select(column).first()
    pivot = np.asarray(some[0], float) if some else np.zeros(0)

    def fold(batches):
        n, mean, cross = 0, np.zeros(len(pivot)), np.zeros((len(pivot), len(pivot)))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf[column].to_numpy()).astype(float) - pivot
            here, size = x.mean(0), len(x)
            x = x - here
            step = here - mean
            cross += x.T @ x + np.outer(step, step) * (n * size / (n + size))
            mean = mean + step * (size / (n + size))
            n += size
        if n:
            width = len(pivot)
            yield pd.DataFrame({
                "i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width),
                "n": n, "mi": np.repeat(mean, width), "mj": np.tile(mean, width), "c": cross.ravel()})

    return vectors.select(column).mapInPandas(
        fold, "i int, j int, n long, mi double, mj double, c double")


def _distance(cross: Column, own_i: Column, own_j: Column) -> Column:
    root = F.sqrt(own_i) * F.sqrt(own_j)
    root = F.when(root == 0, TINY).otherwise(root)
    return F.greatest(F.lit(0.0), 1 - cross / root)


def feature_distances(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Correlation distance of every feature pair (i < j), negative values set to 0."""
    parts = cut(co_moments(vectors, column))  # features squared rows for each task
    weighted = F.sum(F.col("n") * F.col("mi")) / F.sum("n")
    means = parts.filter("i = j").groupBy("i").agg(weighted.alias("mean"))
    off = [means.select(F.col("i").alias(k), F.col("mean").alias(f"mean_{k}")) for k in "ij"]
    sums = (parts.join(off[0], "i").join(off[1], "j").groupBy("i", "j").agg(F.sum(
        F.col("c") + F.col("n") * (F.col("mi") - F.col("mean_i")) * (F.col("mj") - F.col("mean_j"))
    ).alias("c")))
    return _distances(sums)


def running_distances(vectors: DataFrame, column: str = "vector", order: str = "row_no",
                      block_rows: int = RUN_ROWS) -> DataFrame:
    """Correlation distances whose residuals are taken from the mean of the rows up to each row, itself included.

    Rows are cut into blocks of row numbers. One row per block carries the sums of all features before it; inside a
    block a task forms the running means at once, and reduces its residuals to one matrix of products.
    Rows without a number or vector are left out; equal numbers count in an arbitrary order.
    """
    some = vectors.select(column).where(F.col(column).isNotNull()).first()
    pivot = np.asarray(some[0], float) if some else np.zeros(0)
    width = len(pivot)
    rows = (vectors.where(F.col(order).isNotNull() & F.col(column).isNotNull())
            .select(F.col(order).cast("long").alias("n"), F.col(column).cast("array<double>").alias("x"))
            .withColumn("block", F.expr(f"n div {int(block_rows)}")))

    def total(batches):
        sums, counts = {}, {}
        for pdf in batches:
            for block, part in pdf.groupby("block"):
                x = np.vstack(part["x"].to_numpy()) - pivot
                sums[block] = sums.get(block, 0.0) + x.sum(0)
                counts[block] = counts.get(block, 0) + len(x)
        for block, s in sums.items():
            yield pd.DataFrame({"block": block, "i": np.arange(width), "s": s, "k": counts[block]})

    totals = (rows.mapInPandas(total, "block long, i int, s double, k long")
              .groupBy("block", "i").agg(F.sum("s").alias("s"), F.sum("k").alias("k")))
    before = Window.partitionBy("i").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (totals.select("block", "i", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s"),
                             F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
               .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("c"), F.first("k").alias("k"))
               .select("block", F.col("c.s").alias("s"), "k"))

    def products(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"i": [], "j": [], "c": []})
        x = np.vstack(mine.sort_values("n", kind="stable")["x"].to_numpy()) - pivot
        sums = np.cumsum(x, axis=0) + held["s"].iloc[0]
        x -= sums / (np.arange(1, len(x) + 1) + held["k"].iloc[0])[:, None]
        return pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "c": (x.T @ x).ravel()})

    sums = (rows.groupBy("block").cogroup(carried.groupBy("block")).applyInPandas(products, "i int, j int, c double")
            .groupBy("i", "j").agg(F.sum("c").alias("c")))
    return _distances(cut(sums))


def _distances(sums: DataFrame) -> DataFrame:
    own = sums.filter("i = j")
    left = own.select("i", F.col("c").alias("own_i"))
    right = own.select("j", F.col("c").alias("own_j"))
    return (sums.filter("i < j").join(left, "i").join(right, "j")
            .select("i", "j", _distance(F.col("c"), F.col("own_i"), F.col("own_j")).alias("distance")))


def group_features(distances: DataFrame, most: int = MAX_GROUP) -> list[list[int]]:
    """Single-linkage tree over the features, cut from the top until groups hold <= ``most``.

    The matrix is features x features (hundreds squared at most), so it is handled on the driver.
    """
    edges = sorted((r.distance, r.i, r.j) for r in distances.collect())
    width = max((e[2] for e in edges), default=0) + 1
    tree: dict[int, object] = {i: i for i in range(width)}
    root = list(range(width))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for _, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            tree[a] = (tree[a], tree.pop(b))

    def leaves(node):
        return [node] if isinstance(node, int) else leaves(node[0]) + leaves(node[1])

    def cut_down(node):
        members = leaves(node)
        if len(members) <= max(1, most):
            return [sorted(members)]
        return cut_down(node[0]) + cut_down(node[1])
    return sorted(cut_down(next(iter(tree.values()))))


def minmax_norm(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Scale every feature to [0, 1] over the table (one aggregate, then an expression)."""
    long = vectors.select(F.posexplode(column).alias("i", "x"))
    bounds = long.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i")
    rows = bounds.collect()  # one row per feature
    lo, hi = [[float(r[k]) for r in rows] for k in ("lo", "hi")]
    scaled = F.transform(F.arrays_zip(F.col(column).alias("x"), F.lit(lo).alias("a"),
                                      F.lit(hi).alias("b")),
                         lambda z: (z["x"] - z["a"]) / (z["b"] - z["a"] + F.lit(FLOOR)))
    return vectors.withColumn(column, scaled)


def phase_split(rows: DataFrame, map_rows: int, train_rows: int) -> DataFrame:
    """'map' for rows 0..map_rows, then 'train', then 'score'."""
    n = F.col("row_no")
    return rows.withColumn("phase", F.when(n <= map_rows, "map")
                           .when(n <= map_rows + train_rows, "train").otherwise("score"))


# --- autoencoders --------------------------------------------------------------------

def _squash(x):
    return 1.0 / (1.0 + np.exp(-x))


def corruption_mask(rows: np.ndarray, step: int, features: np.ndarray, corruption: float, seed: int) -> np.ndarray:
    """Which inputs survive: a hash of row number, step and feature, so that it does not depend on how rows are dealt."""
    x = (rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
         + np.asarray(features, np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
         + np.uint64((step * 0x165667B19E3779F9 + seed) % 2 ** 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) * 2.0 ** -53 >= corruption


class _Layer:
    """Tied autoencoders over groups of columns, trained by gradients that tasks add up."""

    def __init__(self, members: list[list[int]], low, high, ratio: float, seed: int):
        rng = np.random.default_rng(seed)
        self.members = [np.array(m) for m in members]
        self.low, self.high = np.asarray(low, float), np.asarray(high, float)
        self.params = []
        for m in self.members:
            inner = int(np.ceil(len(m) * ratio))
            bound = np.sqrt(6.0 / (len(m) + inner))
            self.params.append([rng.uniform(-bound, bound, (len(m), inner)),
                                np.zeros(inner), np.zeros(len(m))])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / (self.high - self.low + FLOOR)

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Root mean square error of every group, one column each."""
        x = self.scaled(x)
        out = []
        for m, (w, hidden, visible) in zip(self.members, self.params):
            again = _squash(_squash(x[:, m] @ w + hidden) @ w.T + visible)
            out.append(np.sqrt(((again - x[:, m]) ** 2).mean(1)))
        return np.column_stack(out)

    def gradient(self, x: np.ndarray, kept=None) -> np.ndarray:
        """Sum over the rows of the gradients of half the squared errors, flattened.

        ``kept`` tells, from features, which of their inputs are seen.
        """
        x = self.scaled(x)
        flat = []
        for m, (w, hidden, visible) in zip(self.members, self.params):
            clean = x[:, m]
            given = clean * kept(m) if kept else clean
            code = _squash(given @ w + hidden)
            again = _squash(code @ w.T + visible)
            outer = (again - clean) * again * (1 - again)
            inner = (outer @ w) * code * (1 - code)
            flat += [(given.T @ inner + outer.T @ code).ravel(), inner.sum(0), outer.sum(0)]
        return np.concatenate(flat)

    def move(self, step: np.ndarray) -> None:
        at = 0
        for group in self.params:
            for k, value in enumerate(group):
                group[k] = value + step[at:at + value.size].reshape(value.shape)
                at += value.size


def _train(vectors: DataFrame, layer: _Layer, inner: _Layer | None, rounds: int, rate: float,
           corruption: float, seed: int) -> None:
    """Full-gradient rounds over all rows: tasks sum, the driver takes one step.

    What travels is the size of the parameters, whatever the number of rows. Steps are scaled
    per parameter by the running size of its gradient.
    """
    first = second = 0.0
    for step in range(1, rounds + 1):
        def gather(batches, step=step):
            total, rows = 0.0, 0
            for pdf in batches:
                if len(pdf):
                    x = np.vstack(pdf["vector"].to_numpy()).astype(float)
                    rows_here = pdf["row_no"].to_numpy()
                    kept = (lambda m: corruption_mask(rows_here, step, m, corruption, seed)) if corruption > 0 else None
                    total = total + layer.gradient(inner.errors(x) if inner else x, kept)
                    rows += len(x)
            if rows:
                yield pd.DataFrame({"k": np.arange(len(total)), "g": total, "n": rows})

        sums = (vectors.select("row_no", "vector").mapInPandas(gather, "k int, g double, n long")
                .groupBy("k").agg((F.sum("g") / F.sum("n")).alias("g")).collect())
        if not sums:
            return
        g = np.zeros(len(sums))
        g[[r["k"] for r in sums]] = [r["g"] for r in sums]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        layer.move(-rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8))


def _bounds(vectors: DataFrame, inner: _Layer | None = None) -> tuple[list[float], list[float]]:
    """Least and greatest value of every column, or of every group's error."""
    def gather(batches):
        low = high = None
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["vector"].to_numpy()).astype(float)
                x = inner.errors(x) if inner else x
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pd.DataFrame({"i": np.arange(len(low)), "lo": low, "hi": high})

    rows = (vectors.select("vector").mapInPandas(gather, "i int, lo double, hi double")
            .groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect())
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def ensemble_fit(vectors: DataFrame, groups: list[list[int]] | None = None, most: int = MAX_GROUP,
                 rounds: int = ROUNDS, rate: float = LEARNING_RATE, ratio: float = HIDDEN_RATIO,
                 corruption: float = 0.0) -> DataFrame:
    """Feature groups, one autoencoder per group and one over their errors, from all rows given.

    Pass the rows of the learning phase. Groups follow the distances from running means. ``corruption`` is the part of the
    inputs that training hides. Returns the model table.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors.select("row_no", "vector"))
    if groups is None:
        groups = group_features(running_distances(vectors), most)
    low = _Layer(groups, *_bounds(vectors), ratio, WEIGHT_SEED)
    _train(vectors, low, None, rounds, rate, corruption, WEIGHT_SEED)
    top = _Layer([list(range(len(groups)))], *_bounds(vectors, low), ratio, WEIGHT_SEED + 1)
    _train(vectors, top, low, rounds, rate, corruption, WEIGHT_SEED + 1)
    rows = []
    for number, layer in enumerate((low, top)):
        for k, (m, (w, hidden, visible)) in enumerate(zip(layer.members, layer.params)):
            rows.append((number, k if number == 0 else len(groups), m.tolist(), w.ravel().tolist(),
                         hidden.tolist(), visible.tolist(), layer.low[m].tolist(), layer.high[m].tolist()))
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def save_model(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("errorifexists").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(path)


def _rebuild(model: DataFrame):
    """The weights (one small row per group) as arrays."""
    parts = []
    for r in model.orderBy("layer", "grp").collect():
        n, h = len(r.visible), len(r.hidden)
        parts.append((r.layer, np.array(r.members), np.array(r.w).reshape(n, h),
                      np.array(r.hidden), np.array(r.visible), np.array(r.low), np.array(r.high)))
    return parts


def _errors(x, w, hidden, visible, low, high):
    scaled = (x - low) / (high - low + FLOOR)
    return np.sqrt(np.mean((scaled - _squash(_squash(scaled @ w + hidden) @ w.T + visible)) ** 2, 1))


def ensemble_score(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """Score vectors with a learnt model: matrix products on Arrow batches."""
    parts = _rebuild(model)

    def predict(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            first = np.column_stack([_errors(x[:, m], *p) for layer, m, *p in parts if layer == 0])
            (_, _, *top), = [p for p in parts if p[0] == 1]
            return _errors(first, *top)
    return score_with(vectors, predict, vector="vector")


def score_with(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray],
               columns: list[str] | None = None, vector: str | None = None,
               name: str = "loss") -> DataFrame:
    """Apply any ``fn(N x M matrix) -> N values`` to plain columns or to a vector column.

    Only the inputs of the function leave the JVM.
    """
    def run(given: pd.Series) -> pd.Series:
        if not len(given):
            return pd.Series([], dtype=float)
        return pd.Series(np.asarray(fn(np.vstack(given.to_numpy()).astype(float)), dtype=float))

    inputs = F.col(vector) if vector else F.array(*[F.col(c).cast("double") for c in columns])
    return rows.withColumn(name, F.pandas_udf(run, "double")(inputs))


def process(vectors: DataFrame, model: DataFrame, map_rows: int, train_rows: int) -> DataFrame:
    """Score 0 for the learning phases, the model's score afterwards."""
    phased = phase_split(vectors, map_rows, train_rows)
    scored = ensemble_score(phased.filter("phase = 'score'"), model)
    quiet = phased.filter("phase <> 'score'").withColumn("loss", F.lit(0.0))
    return scored.unionByName(quiet)
