"""Choosing sources for training and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from floodlens.functions.blocks import first_rows
from floodlens.operators.prepare import ip_only


def ip_packet_counts(packets: DataFrame) -> DataFrame:
    return ip_only(packets).groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"))


def eligible_ips(counts: DataFrame, least: int, most: int,
                 ignored: DataFrame | None = None) -> DataFrame:
    kept = counts.filter(F.col("packets").between(least, most))
    if ignored is not None:
        kept = kept.join(ignored.select("src_ip"), "src_ip", "left_anti")
    return kept


def _order(technique: str, seed: int):
    orders = {"mostactive": [F.desc("packets"), "src_ip"],
              "leastactive": [F.asc("packets"), "src_ip"],
              "random": [F.md5(F.concat("src_ip", F.lit(f":{seed}"))), "src_ip"]}
    if technique not in orders:
        raise ValueError(f"technique must be one of {sorted(orders)}")
    return orders[technique]


def select_ips(eligible: DataFrame, n: int, technique: str = "mostactive",
               seed: int = 7) -> DataFrame:
    """The first n sources in selection order (a distributed top-n)."""
    return eligible.orderBy(*_order(technique, seed)).limit(n)


def train_test_ips(eligible: DataFrame, train: int, test: int, technique: str = "mostactive",
                   seed: int = 7) -> DataFrame:
    """Interleaved split: every (r+1)-th source goes to test, r = round(train / test).

    Once one side is full, the rest goes to the other. Works on the chosen
    ``train + test`` sources only.
    """
    if train < 0 or test < 0:
        raise ValueError("counts must not be negative")
    chosen = select_ips(eligible, train + test, technique, seed)
    if train == 0 or test == 0:
        return chosen.select("src_ip", F.lit("train" if train else "test").alias("subset"))
    r = round(train / test)
    ordered = Window.orderBy(*_order(technique, seed))
    k = F.col("_k")
    placed = chosen.withColumn("_k", F.row_number().over(ordered) - 1)
    to_train = k % (r + 1) != r
    # sources placed on each side before position k, while the pattern holds
    tests_before = F.floor(k / (r + 1))
    trains_before = k - tests_before
    full_train, full_test = trains_before >= train, tests_before >= test
    side = (F.when(full_train, "test").when(full_test, "train")
            .when(to_train, "train").otherwise("test"))
    out = placed.select("src_ip", "_k", side.alias("subset"))
    everything = Window.partitionBy()
    trains = F.count_if(F.col("subset") == "train").over(everything)
    tests = F.count_if(F.col("subset") == "test").over(everything)
    first = F.min(F.when(F.col("subset") == "train", F.col("_k"))).over(everything)
    lopsided = (tests > 0) & (trains >= 2 * r * tests)
    move = lopsided & (F.col("_k") == first)
    return (out.withColumn("_move", move)
            .select("src_ip", F.when(F.col("_move"), "test").otherwise(F.col("subset"))
                    .alias("subset")))


def limit_rows(df: DataFrame, order, n: int) -> DataFrame:
    """The first ``n`` rows in order; see ``first_rows``."""
    return first_rows(df, [order] if isinstance(order, str) else list(order), n)
