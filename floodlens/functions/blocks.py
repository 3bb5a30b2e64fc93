"""Running aggregates and as-of lookups that never put a whole key into one task.

A hot key may hold a large part of all rows, so a plain ``partitionBy(key)`` window is
avoided. Rows are cut into blocks by a row number that is unique in the table (the
arrival index); a window runs inside ``(key, block)``, which holds at most
``block_rows`` rows, and a second, much smaller table with one row per
``(key, block)`` carries the state across blocks. Keys and row numbers must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodlens.session import cut

BLOCK_ROWS = 1 << 20
_B = "__block"


def with_block(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn(_B, F.expr(f"`{order}` div {int(block_rows)}"))


def attach(df: DataFrame, state: DataFrame, names) -> DataFrame:
    """Left join the per-block ``state``; plain equality keeps the existing partitioning."""
    return df.join(state, list(names), "left")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column],
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add running sums of ``sums`` over ``keys`` ordered by ``order``, a unique integer."""
    upto = (Window.unboundedPreceding, 0)
    zero = F.lit(0)
    base = with_block(df.withColumns({f"__v_{n}": c for n, c in sums.items()}), order, block_rows)
    block = _B
    groups = [*keys, block]
    inner = Window.partitionBy(*groups).orderBy(order).rowsBetween(*upto)
    rows = base.withColumns({f"__r_{n}": F.coalesce(F.sum(f"__v_{n}").over(inner), zero)
                             for n in sums})
    totals = base.groupBy(*groups).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, *[
        F.coalesce(F.sum(f"__t_{n}").over(before), zero).alias(f"__o_{n}") for n in sums])
    out = attach(rows, offsets, groups).withColumns(
        {n: F.col(f"__r_{n}") + F.coalesce(F.col(f"__o_{n}"), zero) for n in sums})
    drop = [f"__{p}_{n}" for n in sums for p in ("v", "r", "o")]
    return out.drop(*drop, _B)


def previous(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add, per row, the given values of the preceding row of the same key (lag 1)."""
    base = with_block(df, order, block_rows)
    groups = [*keys, _B]
    pack = F.struct(*[c.alias(n) for n, c in values.items()])
    inner = Window.partitionBy(*groups).orderBy(order)
    rows = base.withColumn("__prev", F.lag(pack).over(inner))
    newest = base.groupBy(*groups).agg(F.max_by(pack, F.col(order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(_B)
    carry = newest.select(*groups, F.lag("__last").over(across).alias("__carry"))
    out = attach(rows, carry, groups)
    chosen = F.coalesce(F.col("__prev"), F.col("__carry"))
    return (out.withColumn("__chosen", chosen)
            .withColumns({n: F.col("__chosen")[n] for n in values})
            .drop("__prev", "__carry", "__chosen", _B))


def running_max(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    base = with_block(df.withColumn("__v", value), order, block_rows)
    groups = [*keys, _B]
    inner = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("__r", F.max("__v").over(inner))
    tops = base.groupBy(*groups).agg(F.max("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*groups, F.max("__t").over(before).alias("__o"))
    return (attach(rows, carry, groups)
            .withColumn(name, F.greatest("__r", "__o"))
            .drop("__v", "__r", "__o", _B))


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], order: str,
              values: list[str], strict: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Attach to each ``left`` row the ``values`` of the latest ``right`` row of its key.

    Latest means greatest ``order`` not above (``strict``: below) the left row's. ``order`` is
    an integer; within a key it is unique on the right. Unmatched rows get nulls. Both sides are read
    twice; values of fixed size carry from block to block without a sort.
    """
    groups = [*keys, _B]
    l = with_block(left, order, block_rows)
    r = with_block(right.select(*keys, order, *values), order, block_rows)
    pack = F.struct(*[F.col(v) for v in values])
    both = (l.withColumn("__kind", F.lit(0 if strict else 2))
            .unionByName(r.select(*groups, order, F.lit(1).alias("__kind"), pack.alias("__val")), allowMissingColumns=True))
    inner = (Window.partitionBy(*groups).orderBy(order, "__kind")
             .rowsBetween(Window.unboundedPreceding, 0))
    rows = (both.withColumn("__in", F.last("__val", ignorenulls=True).over(inner))
            .filter(F.col("__kind") != 1).drop("__kind", "__val"))
    newest = (r.groupBy(*groups).agg(*[F.max_by(v, order).alias(v) for v in values])
              .select(*groups, F.lit(1).alias("__kind"), pack.alias("__val")))
    asked = l.select(*groups).distinct().withColumn("__kind", F.lit(0))
    before = Window.partitionBy(*keys).orderBy(_B, "__kind").rowsBetween(Window.unboundedPreceding, -1)
    carry = (asked.unionByName(newest, allowMissingColumns=True)
             .withColumn("__carry", F.last("__val", ignorenulls=True).over(before))
             .filter((F.col("__kind") == 0) & F.col("__carry").isNotNull()).select(*groups, "__carry"))
    return (attach(rows, carry, groups).withColumn("__hit", F.coalesce("__in", "__carry"))
            .select(*left.columns, *[F.col("__hit")[v].alias(v) for v in values]))


def last_points(df: DataFrame, keys: list[str], order: str, point: Column, n: int, name: str,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the array of the last ``n`` points of the key, oldest first, this row's included."""
    base = with_block(df.withColumn("__p", point), order, block_rows)
    groups = [*keys, _B]
    inner = Window.partitionBy(*groups).orderBy(order)
    recent = [F.lag("__p", i).over(inner) for i in range(n - 1, 0, -1)] + [F.col("__p")]
    rows = base.withColumn("__in", F.array_compact(F.array(*recent)))
    tails = rows.groupBy(*groups).agg(F.max_by("__in", order).alias("__tail"))
    # every block of a key holds at least one of its points: n-1 earlier blocks suffice
    back = Window.partitionBy(*keys).orderBy(_B).rowsBetween(-(n - 1), -1)
    carry = tails.select(*groups, F.flatten(F.collect_list("__tail").over(back)).alias("__c"))
    both = F.concat(F.col("__c"), F.col("__in"))
    out = attach(rows, carry, groups).withColumn("__all", both)
    return (out.withColumn(name, F.expr(f"slice(__all, greatest(1, size(__all) - {n - 1}), {n})"))
            .drop("__p", "__in", "__c", "__all", _B))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in order, without a task that sorts or carries them all; among equals any.

    Rows are stored in ranges of the order. The number of rows per range tells which ranges are in as a whole, and how many
    rows of the one behind them; only that one is ranked. The rows come in no particular order.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("__before", before).filter(F.col("__before") < n)
    near = ranged.join(wanted, "__part")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    edge = (near.filter(F.col("__before") + F.col("__n") > n).withColumn("__rank", rank)
            .filter(F.col("__rank") <= n - F.col("__before")).drop("__rank"))
    return near.filter(F.col("__before") + F.col("__n") <= n).unionByName(edge).select(*df.columns)
