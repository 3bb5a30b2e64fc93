"""Decayed histograms and the anomaly score read from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Bins:
    """Even bins over [lower, upper)."""

    lower: float
    upper: float
    count: int

    @property
    def width(self) -> float:
        return (self.upper - self.lower) / self.count

    def index(self, value: Column) -> Column:
        return F.floor((value - self.lower) / self.width)

    def inside(self, value: Column) -> Column:
        return self.index(value).between(0, self.count - 1)


def learn_bins(df: DataFrame, value: str, order: str, grace: int, count: int) -> tuple[Bins, int]:
    """Range of the first ``grace - 1`` rows, widened by its width on each side.

    While all of them are equal, the period is prolonged by 1000 rows. Row numbers start at 0.
    Returns the bins and the number of rows used up.
    """
    start = df.filter(F.col(order) == 0).select(value).first()
    same = F.lit(start[0] if start else None)
    rows, change = df.agg(F.count(F.lit(1)), F.min(F.when(F.col(value) != same, F.col(order)))).first()
    if change is not None and change >= grace - 1:
        grace += 1000 * -(-(change - grace + 2) // 1000)
    if change is None or grace > rows:
        raise ValueError("not enough different values to learn a range")
    lo, hi = df.filter(F.col(order) < grace - 1).agg(F.min(value), F.max(value)).first()
    width = hi - lo
    return Bins(lo - width, hi + width, count), grace


def decayed_histogram(df: DataFrame, value: str, time: str, bins: Bins, rate: float,
                      keys=()) -> DataFrame:
    """Weight and last time per bin; rows out of range are ignored.

    Each bin decays up to its own last row. Exponents are cut into spans (see ``damped``),
    so one partial aggregation suffices.
    """
    e = F.col(time) * rate
    rows = (df.filter(bins.inside(F.col(value)))
            .withColumn("bin", bins.index(F.col(value)))
            .withColumn("_span", F.floor(e / 256))
            .withColumn("_u", F.pow(F.lit(2.0), e - F.floor(e / 256) * 256)))
    spans = rows.groupBy(*keys, "bin", "_span").agg(
        F.sum("_u").alias("_w"), F.max("_u").alias("_top"), F.max(time).alias("last_t"))
    by_bin = Window.partitionBy(*keys, "bin").orderBy("_span")
    newest = F.row_number().over(Window.partitionBy(*keys, "bin").orderBy(F.desc("_span")))
    near = F.lag("_span").over(by_bin) == F.col("_span") - 1
    carried = F.when(near, F.lag("_w").over(by_bin) * 2.0 ** -256).otherwise(0.0)
    return (spans.withColumn("weight", (F.col("_w") + carried) / F.col("_top"))
            .withColumn("_new", newest).filter("_new = 1")
            .select(*keys, "bin", "weight", "last_t"))


def decay_to(hist: DataFrame, now, rate: float) -> DataFrame:
    gap = F.greatest(F.lit(0.0), F.lit(now) - F.col("last_t"))
    return hist.withColumn("weight", F.col("weight") * F.pow(F.lit(2.0), -rate * gap))


def histogram_score(values: DataFrame, value: str, hist: DataFrame, bins: Bins, win: int = 0,
                    lower_is_anomaly: bool = True, upper_is_anomaly: bool = True) -> DataFrame:
    """ln(tallest / mean weight of the bins around the value); infinite where empty or outside.

    The bin table has at most ``bins.count`` rows, each turned into one neighbourhood mean.
    """
    tallest = hist.agg(F.max("weight")).first()[0] or 0.0
    grid = hist.sparkSession.range(bins.count).select(F.col("id").alias("bin"))
    full = grid.join(hist.select("bin", "weight"), "bin", "left").fillna(0.0, ["weight"])
    near = full.select(F.explode(F.sequence(F.col("bin") - win, F.col("bin") + win)).alias("_bin"),
                       "weight")
    means = near.groupBy("_bin").agg(F.avg("weight").alias("_w"))
    index = bins.index(F.col(value))
    out = values.withColumn("_bin", index).join(means, "_bin", "left")
    above, below = F.col("_bin") - win > bins.count - 1, F.col("_bin") + win < 0
    infinite = F.lit(float("inf"))
    score = (F.when(above, infinite if upper_is_anomaly else F.lit(0.0))
             .when(below, infinite if lower_is_anomaly else F.lit(0.0))
             .when(F.col("_w") == 0, infinite)
             .otherwise(F.ln(F.lit(tallest) / F.col("_w"))))
    return out.withColumn("score", score).drop("_bin", "_w")


def histogram_freq(hist: DataFrame) -> DataFrame:
    """Share of every bin in the total weight (bounded by the number of bins)."""
    whole = Window.partitionBy()
    return hist.withColumn("freq", F.col("weight") / F.sum("weight").over(whole))
