"""Feature vector files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from floodlens.functions.blocks import first_rows


class VectorError(ValueError):
    """Readers of different width, or fewer rows than asked for."""


def read_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Header-less numeric CSV as ``(row_no, vector)``, numbered in file order."""
    if width is None:
        width = len(spark.read.csv(path).columns)
    schema = T.StructType([T.StructField(f"_c{i}", T.DoubleType()) for i in range(width)])
    rows = number_rows(spark.read.schema(schema).csv(path))
    return rows.select("row_no", F.array(*[f"_c{i}" for i in range(width)]).alias("vector"))


def number_rows(scan: DataFrame, name: str = "row_no") -> DataFrame:
    """Add dense row numbers in file order (files by name, rows by position) to a file scan.

    Rows of one split are consecutive in ``monotonically_increasing_id``. A table with one row
    per split gives each split its offset, so no row is sorted or moved.
    """
    tagged = scan.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_start"),
                         F.monotonically_increasing_id().alias("_id"))
    splits = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"),
                                                   F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (tagged.join(offsets, ["_file", "_start"])
            .select((F.col("_offset") + F.col("_id") - F.col("_first")).alias(name), *scan.columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_no long, vector array<double>").parquet(path)


def read_many(readers: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Concatenate readers in order; all of one width, at least ``limit`` rows."""
    tagged = [r.withColumn("file_no", F.lit(i)) for i, r in enumerate(readers)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    size = F.size("vector")
    low, high, rows = both.agg(F.min(size), F.max(size), F.count(F.lit(1))).first()
    if low != high:
        raise VectorError(f"vectors of width {low} and {high}")
    if limit is None:
        return both
    if rows < limit:
        raise VectorError(f"not enough rows ({rows} < {limit})")
    return first_rows(both, ["file_no", "row_no"], limit)
