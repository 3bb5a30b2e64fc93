"""Session helpers: where to cut lineage and where to put intermediate files."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="floodlens-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/floodlens/{name}-{uuid.uuid4().hex}"


_open = threading.local()
#: While a chain of stages runs: files of an exchange go with the job that made them, and tables are packed closer.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def cut(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Later uses start from the table, lost executors do not force a recomputation, and, unlike
    an RDD checkpoint, the planner sees sizes and prunes columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_last(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` what ``make`` gives, and drop the tables that were cut on the way: nothing else may read them."""
    outer, before = getattr(_open, "paths", None), {k: spark.conf.get(k) for k in _LEAN}
    _open.paths = passed = []
    try:
        for k, v in _LEAN.items():
            spark.conf.set(k, v)
        made = make()
        _open.paths = outer
        out = cut(made)
    finally:
        _open.paths = outer
        for k, v in before.items():
            spark.conf.set(k, v)
    for path in passed:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return out
