"""Running streams over what is available."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def state_partitions(spark: SparkSession, number: int | None):
    """Number of state partitions of the queries started inside.

    It is fixed for the life of a checkpoint, so it is worth choosing by the cores at hand.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if number:
        spark.conf.set(name, number)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def begin(writer, checkpoint: str, spark: SparkSession, partitions: int | None = None):
    """Start handling everything available in micro-batches."""
    with state_partitions(spark, partitions):
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str,
                 partitions: int | None = None) -> None:
    """Append what is available to a table."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    begin(writer, checkpoint, stream.sparkSession, partitions).awaitTermination()
