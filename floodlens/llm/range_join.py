"""Near-duplicate vectors by an exact metric range join.

Cosine similarity of at least ``c`` is a Euclidean distance of at most ``r = sqrt(2 - 2c)`` between unit vectors.

1. Equal vectors of a label form one class; only classes go on.
2. Cells start as one per label. A cell with too many vectors is cut by pivots drawn from it: each vector is at home in the
   cell of its nearest pivot, and is copied to every other cell that may be home to a vector within ``r`` of it. By the
   triangle inequality that takes ``d(x, q) <= d(x, p) + 2r``; since distances are Euclidean, the distance of ``x`` to the
   plane that halves the way from ``p`` to ``q`` must not exceed ``r`` either, which is the sharper bound. A cut that saves too little
   (vectors that lie within ``r`` of each other, or on all sides) is undone.
3. Cells are joined independently: all neighbours of a vector are in its home cell, so its links are counted there. A cell
   that stayed large is dealt into blocks of bounded size, which count parts. What leaves a task is a number for each vector
   and a star for each group of linked vectors, never pairs.
4. Stars become connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from floodlens.llm.common import arrow_schema
from floodlens.llm.graph import components
from floodlens.session import cut

#: A cut must save this part of the comparisons of a cell, and takes at most so many pivots.
GAIN, PIVOTS = 0.2, 64
MARGIN = 1e-9
MEMBER = "cell string, home boolean, h1 bigint, h2 bigint, rep bigint, copies bigint, unit binary"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can meet what was made of it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def unit_vectors(classes: DataFrame) -> DataFrame:
    """Members of the first cells, one for each label and width."""
    schema = arrow_schema(MEMBER)

    def run(batches):
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            out = []
            for x in v:
                x = np.array(x.as_py(), float)
                x = x / np.abs(x).max()  # neither squares nor roots leave the range of doubles
                out.append((x / np.sqrt(x @ x)).tobytes())
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            yield pa.RecordBatch.from_arrays(
                [col("cell"), pa.array([True] * batch.num_rows), col("h1"), col("h2"), col("rep"), col("copies"),
                 pa.array(out, pa.binary())], schema=schema)

    return classes.mapInArrow(run, MEMBER)


def matrix(units: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(units.to_pylist())
    return np.frombuffer(data, float).reshape(len(units), -1)


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and (rows x pivots) whether a vector at home there may lie within the radius."""
    distance = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))
    nearest = distance.argmin(axis=1)
    own = distance[np.arange(len(x)), nearest]
    may = distance <= own[:, None] + 2 * radius + MARGIN
    for p in range(len(pivots)):
        apart = np.sqrt(np.maximum(0.0, ((pivots - pivots[p]) ** 2).sum(axis=1)))
        over = (distance ** 2 - distance[:, p:p + 1] ** 2) / (2 * np.maximum(apart, 1e-12))
        may &= (over <= radius + MARGIN) | (apart < 1e-6)
    return nearest, may


def split(members: DataFrame, sizes: DataFrame, radius: float, cell_rows: int, task_rows: int) -> DataFrame:
    """The members of the cells in ``sizes`` (cell, homes, members), dealt to cells around pivots drawn from their homes."""
    wanted = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("homes") / cell_rows))
    near = members.join(sizes, "cell")
    draw = Window.partitionBy("cell").orderBy(F.xxhash64("h1", "cell"), "h1", "h2")
    pivots = (near.where("home").select("cell", "homes", "members", "h1", "h2", "unit")
              .withColumn("no", F.row_number().over(draw)).where(F.col("no") <= PIVOTS).where(F.col("no") <= wanted))
    parts = F.ceil(F.col("members") / task_rows).cast("int")
    rows = near.select("cell", "home", "h1", "h2", "rep", "copies", "unit", F.pmod(F.xxhash64("h2", "h1"), parts).cast("int").alias("part"))
    sent = pivots.select("cell", "no", "unit", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    schema = arrow_schema(MEMBER)

    def deal(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        pivots = pivots.sort_by("no")
        x = matrix(rows["unit"])
        nearest, may = cells_of(x, matrix(pivots["unit"]), radius)
        home = rows["home"].to_numpy()
        may[home, nearest[home]] = False
        homes = np.nonzero(home)[0]
        away, where = np.nonzero(may)
        back = pa.array(np.concatenate([homes, away]))
        no = np.concatenate([nearest[homes], where])
        out = rows.take(back)
        prefix = rows["cell"][0].as_py()
        names = pa.array([f"{prefix}.{k}" for k in range(pivots.num_rows)])
        flags = pa.array(np.arange(len(no)) < len(homes))
        return pa.table([names.take(pa.array(no)), flags, *(out[c] for c in ("h1", "h2", "rep", "copies", "unit"))], schema=schema)

    return rows.groupBy("cell", "part").cogroup(fresh(sent).groupBy("cell", "part")).applyInArrow(deal, MEMBER)


def cell_sizes(members: DataFrame) -> DataFrame:
    return (members.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("members"))
            .where("homes > 0"))


def metric_cells(members: DataFrame, radius: float, cell_rows: int, task_rows: int, levels: int = 12) -> list[tuple[DataFrame, DataFrame]]:
    """(members, sizes) of the final cells, level by level."""
    done, open_cells = [], cut(cell_sizes(members))
    for _ in range(levels):
        large = open_cells.where(F.col("homes") > cell_rows)
        if large.isEmpty():
            break
        dealt = cut(split(members, large, radius, cell_rows, task_rows))
        sizes = cut(cell_sizes(dealt))
        parent = F.regexp_replace("cell", r"\.[0-9]+$", "")
        work = F.col("homes").cast("double") * F.col("members")
        less = sizes.groupBy(parent.alias("cell")).agg(F.sum(work).alias("after"))
        good = cut(large.join(less, "cell").where(F.col("after") <= (1 - GAIN) * work).select("cell"))
        done.append((members, open_cells.join(good, "cell", "left_anti")))
        members = dealt
        open_cells = cut(sizes.withColumn("parent", parent).join(good.withColumnRenamed("cell", "parent"), "parent", "left_semi").drop("parent"))
    done.append((members, open_cells))
    return done


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether unit rows reach the cosine; sums near the bound are taken again with more digits."""
    found = x @ y.T
    out = found >= cosine
    for i, j in zip(*np.nonzero(np.abs(found - cosine) < 1e-13)):
        a, b = x[i].astype(np.longdouble), y[j].astype(np.longdouble)
        out[i, j] = float(a @ b / np.sqrt((a @ a) * (b @ b))) >= cosine
    return out


def stars(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for all linked rows and columns of a block."""
    rows, columns = links.any(axis=1), links.any(axis=0)
    links, a, b = links[rows][:, columns], left[rows].copy(), right[columns].copy()
    top = np.iinfo(np.int64).max
    while len(a):
        low_a = np.minimum(a, np.concatenate([np.where(part, b, top).min(axis=1) for part in np.array_split(links, -(-len(links) // 128))]))
        low_b = np.minimum(b, np.minimum.reduce([np.where(links[k:k + 128], low_a[k:k + 128, None], top).min(axis=0) for k in range(0, len(a), 128)]))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    return np.concatenate([left[rows], right[columns]]), np.concatenate([a, b])


def joined(members: DataFrame, sizes: DataFrame, cosine: float, cell_rows: int, task_rows: int) -> DataFrame:
    """(h1, h2, rep, n): parts of each home's number of linked vectors, itself included; with h1 null, edges (rep, n)."""
    out = arrow_schema("h1 bigint, h2 bigint, rep bigint, n bigint")
    near = members.join(sizes, "cell")
    across, down = F.ceil(F.col("homes") / cell_rows).cast("int"), F.ceil(F.col("members") / task_rows).cast("int")
    salt = F.xxhash64("h2", "h1")
    whole = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    homes = near.where("home").select("cell", "h1", "h2", "rep", "unit", F.pmod(salt, across).cast("int").alias("i"), whole(down).alias("j"))
    all_rows = near.select("cell", "rep", "copies", "unit", F.pmod(salt, down).cast("int").alias("j"), whole(across).alias("i"))

    def meet(homes: pa.Table, rows: pa.Table) -> pa.Table:
        if not homes.num_rows or not rows.num_rows:
            return out.empty_table()
        links = linked(matrix(homes["unit"]), matrix(rows["unit"]), cosine)
        n = links @ rows["copies"].to_numpy()
        node, low = stars(links, homes["rep"].to_numpy(), rows["rep"].to_numpy())
        edge = node != low
        none = pa.nulls(int(edge.sum()), pa.int64())
        counts = pa.table([homes["h1"], homes["h2"], homes["rep"], pa.array(n)], schema=out)
        return pa.concat_tables([counts, pa.table([none, none, pa.array(node[edge]), pa.array(low[edge])], schema=out)])

    return homes.groupBy("cell", "i", "j").cogroup(fresh(all_rows).groupBy("cell", "i", "j")).applyInArrow(
        meet, "h1 bigint, h2 bigint, rep bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str = "label", cell_rows: int = 1024, task_rows: int = 8192) -> DataFrame:
    """id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept (its own component's id).

    Vectors are linked if they have one label and a cosine of at least ``cosine``, in double precision. Vectors that are
    null, empty, zero, or hold null or non-finite components, and those with a null label or id, link with nothing, and
    vectors of different widths never do. Rows with equal ids count as vectors of their own but as one node of
    the graph. A null id has a null component and is kept. Other columns are ignored; an empty table gives no rows.
    """
    v = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0))
    ok = usable(F.col(vector_column)) & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(ok, F.concat_ws("/", F.col(label_column).cast("string"), F.size(v))).alias("cell"),
                           F.when(ok, v).alias("v"))
    # equal vectors are found by 128 bits of hash
    signed = named.select("id", "cell", "v", F.xxhash64("cell", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "cell").alias("h2"))
    classes = (signed.where("cell IS NOT NULL").groupBy("cell", "h1", "h2", "v")
               .agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = cut(unit_vectors(classes))
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    found = None
    for part, sizes in metric_cells(members, radius, cell_rows, task_rows):
        rows = joined(part, sizes, cosine, cell_rows, task_rows)
        found = rows if found is None else found.unionByName(rows)
    found = cut(found)
    counts = found.where("h1 IS NOT NULL").groupBy("h1", "h2", "rep").agg((F.sum("n") - 1).alias("n_links"))
    ids = signed.where("cell IS NOT NULL").select("id", "h1", "h2")
    reps = counts.select("h1", "h2", "rep")
    twice = ids.groupBy("id").agg(F.count_distinct("h1", "h2").alias("k")).where("k > 1").select("id")
    same = ids.join(twice, "id").join(reps, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = found.where("h1 IS NULL").select(F.col("rep").alias("a"), F.col("n").alias("b")).unionByName(same)
    placed = counts.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n_links", F.coalesce("component", "rep").alias("component"))
    keyed = signed.select("id", F.when(F.col("cell").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("cell").isNotNull(), F.col("h2")).alias("h2"))
    return (keyed.join(placed, ["h1", "h2"], "left")
            .withColumn("component_id", F.coalesce("component", "id"))
            .select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id",
                    F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")))
