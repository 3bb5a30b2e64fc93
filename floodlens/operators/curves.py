"""ROC curves, AUC and score series.

Scores are counted per distinct value first; cumulative counts run inside score ranges of
about ``RANGE_SCORES`` distinct scores, plus one offset per range, so no single task ever
orders all scores. Rows without a score are no part of a curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE_SCORES = 1 << 18


def _range_of(df: DataFrame, score: str, range_scores: int) -> Column:
    """Index of the score range, descending: any fixed bounds give exact results."""
    distinct = df.agg(F.approx_count_distinct(score)).first()[0]
    ranges = max(1, -(-distinct // range_scores))
    probabilities = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.approxQuantile(score, probabilities, 0.25 / ranges))) if probabilities else []
    if not bounds:
        return F.lit(0)
    # the number of bounds above the score; it is taken once per distinct score
    above = F.filter(F.lit(bounds), lambda b: b > F.col(score))
    return F.size(above)


def score_counts(df: DataFrame, keys, score: str, label: str,
                 range_scores: int = RANGE_SCORES) -> DataFrame:
    """Per key and distinct score: positives and negatives, here and at greater scores."""
    df = df.filter(F.col(score).isNotNull())
    rng = _range_of(df, score, range_scores)
    counts = (df.groupBy(*keys, score)
              .agg(F.count_if(F.col(label) == 1).alias("pos"),
                   F.count_if(F.col(label) != 1).alias("neg"))
              .withColumn("_range", rng))
    inside = (Window.partitionBy(*keys, "_range").orderBy(F.desc(score))
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = counts.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    over_ranges = Window.partitionBy(*keys).orderBy("_range")
    before = over_ranges.rowsBetween(Window.unboundedPreceding, -1)
    every = over_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    offsets = totals.select(
        *keys, "_range", F.coalesce(F.sum("_p").over(before), zero).alias("_p0"),
        F.coalesce(F.sum("_n").over(before), zero).alias("_n0"),
        F.sum("_p").over(every).alias("pos_all"), F.sum("_n").over(every).alias("neg_all"))
    local = counts.withColumns({
        "_pb": F.coalesce(F.sum("pos").over(inside), zero),
        "_nb": F.coalesce(F.sum("neg").over(inside), zero)})
    return (local.join(offsets, [*keys, "_range"])
            .withColumn("pos_above", F.col("_pb") + F.col("_p0"))
            .withColumn("neg_above", F.col("_nb") + F.col("_n0"))
            .drop("_range", "_pb", "_nb", "_p0", "_n0"))


def roc_curve(df: DataFrame, keys=(), score: str = "score", label: str = "label") -> DataFrame:
    """One point per distinct score used as threshold (rows scoring at least that much)."""
    counts = score_counts(df, list(keys), score, label)
    return counts.select(
        *keys, F.col(score).alias("threshold"),
        F.try_divide(F.col("neg_above") + F.col("neg"), "neg_all").alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), "pos_all").alias("tpr"))


def auc(df: DataFrame, keys=(), score: str = "score", label: str = "label") -> DataFrame:
    """Area under the curve (trapezoids, so ties count half); null with one class only."""
    counts = score_counts(df, list(keys), score, label)
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    value = F.try_divide(area, F.max("pos_all").cast("double") * F.max("neg_all"))
    return counts.groupBy(*keys).agg(value.alias("auc"))


def auc_by_group(df: DataFrame, group: str, skip: int = 0, **names) -> DataFrame:
    """AUC per run; runs below ``skip`` are reported as null."""
    areas = auc(df.filter(F.col(group) >= skip), [group], **names)
    runs = df.select(group).distinct()
    return runs.join(areas, group, "left")


def scores_with_labels(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Pair scores and labels by row number; both sides must be equally long."""
    from floodlens.operators.prepare import CountMismatch

    if scores.count() != labels.count():
        raise CountMismatch("scores and labels differ in number")
    return scores.join(labels, "row_no")


def score_series(df: DataFrame, skip: int = 0, end: int | None = None, row: str = "row_no",
                 time: str = "ts_ns") -> DataFrame:
    """Rows ``skip <= row < end`` with the time since the first kept row."""
    kept = df.filter(F.col(row) >= skip)
    if end is not None:
        kept = kept.filter(F.col(row) < end)
    first = df.filter(F.col(row) == skip).agg(F.min(time)).first()[0]
    return kept.withColumn("elapsed_s", (F.col(time) - F.lit(first)) / 1e9)


def smallest_positive(df: DataFrame, score: str = "score") -> DataFrame:
    """Linear threshold of a log-scaled plot: least positive score, at most 1."""
    least = F.min(F.when(F.col(score) > 0, F.col(score)))
    return df.agg(F.least(F.lit(1.0), least).alias("linthresh"))
