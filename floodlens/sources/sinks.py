"""Writers. Each one returns the written data read back, so that it can be chained."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from floodlens.session import scratch_path


def write_decisions(rows: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """Header-less CSV rows such as ``ip,loss,label``."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, "decisions")
    picked = rows.select(*columns)
    picked.write.mode("errorifexists").csv(path)
    return spark.read.schema(picked.schema).csv(path)


def write_dataset(dataset: DataFrame, path: str | None = None, separate: bool = False,
                  fmt: str = "parquet") -> DataFrame:
    """Labelled rows in one data set, or one folder per class."""
    spark = dataset.sparkSession
    path = path or scratch_path(spark, "dataset")
    writer = dataset.write.mode("errorifexists")
    if separate:
        writer = writer.partitionBy("target")
    if fmt == "csv":
        writer.option("header", True).csv(path)
        return spark.read.schema(dataset.schema).option("header", True).csv(path)
    writer.parquet(path)
    return spark.read.schema(dataset.schema).parquet(path)


def write_vectors(vectors: DataFrame, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Vector sink: ``row_no`` plus an array column, or header-less CSV text lines."""
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vectors")
    if fmt == "csv":
        line = F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))
        vectors.sort("row_no").select(line.alias("value")).write.text(path)
        return spark.read.text(path)
    vectors.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_subsets(packets: DataFrame, path: str | None = None) -> DataFrame:
    """Packet subsets, one folder per ``subset`` value."""
    spark = packets.sparkSession
    path = path or scratch_path(spark, "subsets")
    packets.write.mode("errorifexists").partitionBy("subset").parquet(path)
    return spark.read.schema(packets.schema).parquet(path)
