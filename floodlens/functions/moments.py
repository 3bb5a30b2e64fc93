"""Merging of per-slice means and squared deviations."""

from pyspark.sql import Column, functions as F


def squared_deviation(value: Column) -> Column:
    """Sum of squared deviations from the mean, as an aggregate."""
    return F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0))


def merged_deviation(count: Column, mean: Column, m2: Column, overall: Column) -> Column:
    """Aggregate merging slices around a known overall mean (no cancellation)."""
    diff = mean - overall
    return F.sum(m2 + F.when(count > 0, count * diff * diff).otherwise(0.0))


def sample_std(m2: Column, n: Column) -> Column:
    return F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(F.lit(0.0))
