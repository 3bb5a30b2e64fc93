"""Running statistics, entropy, sampling and sketches as reusable transformations.

Running statistics are two-level (see ``blocks``): ``order`` is a unique integer row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodlens.functions.blocks import BLOCK_ROWS, running_sums


def running_average(df: DataFrame, keys, order: str, value: str, name: str = "running_avg",
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    out = running_sums(df, keys, order, {"_n": F.lit(1),
                                         "_sum": F.col(value)}, block_rows)
    return out.withColumn(name, F.col("_sum") / F.col("_n")).drop("_n", "_sum")


def running_variance(df: DataFrame, keys, order: str, value: str, name: str = "running_var",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sample variance so far, 0 for one row. Values are centred by the overall mean first."""
    centre = df.agg(F.avg(value)).first()[0] or 0.0
    x = F.col(value) - F.lit(float(centre))
    out = running_sums(df, keys, order, {"_n": F.lit(1), "_s": x, "_q": x * x}, block_rows)
    n = F.col("_n")
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / n)
    return (out.withColumn(name, F.when(n > 1, spread / (n - 1)).otherwise(0.0))
            .drop("_n", "_s", "_q"))


def rolling_mean(df: DataFrame, keys, order: str, value: str, k: int, name: str = "rolling_mean",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean over the last k rows; missing rows count as zeros, so the divisor is always k.

    Rows near the start of a block need up to k-1 rows of the block before, so the last
    k-1 row numbers of each block are also given to the next one. ``order`` must be dense over
    each key, or over the table when there are no keys.
    """
    if k > block_rows:
        raise ValueError("k must not exceed block_rows")
    block = F.expr(f"`{order}` div {block_rows}")
    late = F.expr(f"`{order}` % {block_rows}") >= block_rows - (k - 1)
    targets = F.array(block, F.when(late, block + 1))
    spread = (df.withColumn("_own", block)
              .withColumn("_blk", F.explode(F.array_compact(targets))))
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(-(k - 1), 0)
    return (spread.withColumn(name, F.sum(value).over(w) / k)
            .filter(F.col("_blk") == F.col("_own")).drop("_own", "_blk"))


def entropy_from_freq(freqs: DataFrame, keys, freq: str, normalise: bool = False,
                      name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) from a frequency table, optionally over log2 of the row count."""
    f, n = F.col(freq), F.sum(freq)
    bits = F.log2(n) - F.sum(f * F.log2(f)) / n
    bits = F.greatest(F.lit(0.0), bits)
    if normalise:
        bits = F.when(n > 1, bits / F.log2(n)).otherwise(0.0)
    return freqs.filter(f > 0).groupBy(*keys).agg(bits.alias(name))


def entropy(df: DataFrame, keys, value: str, normalise: bool = False,
            name: str = "entropy") -> DataFrame:
    freqs = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))
    return entropy_from_freq(freqs, keys, "_freq", normalise, name)


def reservoir_sample(df: DataFrame, keys, row_id: str, k: int, seed: int = 7) -> DataFrame:
    """Uniform sample of at most k rows per group: the k smallest seeded hashes.

    Repeatable, independent of partitioning, and cut to k rows per group before the shuffle.
    """
    ticket = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_ticket", row_id))
    return (df.withColumn("_ticket", ticket).withColumn("_rank", rank)
            .filter(F.col("_rank") <= k).drop("_ticket", "_rank"))


def distinct_sketch(df: DataFrame, keys, value: str, lg_k: int = 9) -> DataFrame:
    """Mergeable distinct-count sketch per group."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys, name: str = "distinct") -> DataFrame:
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name)
    return sketches.groupBy(*keys).agg(merged)


def seconds_to_ns(seconds: Column) -> Column:
    """Truncates, as an integer conversion does."""
    product = seconds * 1_000_000_000
    return F.when(product >= 0, F.floor(product)).otherwise(F.ceil(product)).cast("long")


def ns_to_seconds(ns: Column) -> Column:
    return ns.cast("double") / 1e9


def ns_to_whole_seconds(ns: Column) -> Column:
    """Rounded half to even."""
    return F.bround(ns.cast("double") / 1e9).cast("long")
