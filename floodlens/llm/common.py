"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import inspect
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Split a batch so that ``column`` holds about ``most`` bytes in each part (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [value or "" for value in batch.column(column).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


#: What a worker process keeps from task to task, such as an encoder with its cache.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """The worker's own ``name``, made once; it goes when a task of another operator starts."""
    if name not in _KEPT:
        drop_kept()
        _KEPT[name] = make()
    return _KEPT[name]


#: For ``drop_kept``: leave the choice to the task itself.
ANY = "*"


def drop_kept(but: str | None = None) -> None:
    if but == ANY:
        return
    for name in [n for n in _KEPT if n != but]:
        del _KEPT[name]


def give_back() -> None:
    """Return memory that nothing uses to the system: workers are reused, and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    found = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(found), "malloc_trim", None) if found else None
    if trim:
        trim(0)


def thrifty(work: Callable) -> Callable:
    """A function of one group, or of two, that starts without what operators kept, and gives back memory behind it."""

    def measured(*tables):
        drop_kept()
        try:
            return work(*tables)
        finally:
            give_back()

    if len(inspect.signature(work).parameters) == 1:
        return lambda rows: measured(rows)
    return lambda left, right: measured(left, right)


def map_texts(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str,
              carry: Sequence[str] = (), keep: str | None = None, most: int = 1 << 21) -> DataFrame:
    """Apply ``make()(batch) -> list of columns`` to parts of bounded size.

    ``columns`` names what is read, ending with the text column. ``make`` runs once for each task,
    in the worker, so that models and caches are loaded there. ``schema`` is a Spark DDL string for what
    ``make`` gives. Columns in ``carry`` pass through unchanged, behind those. ``keep`` names what the operator keeps in
    its worker; parts hold about ``most`` bytes of text.
    """
    extra = [c for c in carry if c not in columns]
    narrow = df.select(*extra, *columns)
    added = StructType([df.schema[c] for c in carry])
    full = StructType(StructType.fromDDL(schema).fields + added.fields)
    target = to_arrow_schema(full)

    def run(batches):
        drop_kept(keep)
        work = make()
        for batch in batches:
            for part in pieces(batch, columns[-1], most):
                out = work(part.select(columns)) + [part.column(c) for c in carry]
                yield pa.RecordBatch.from_arrays(
                    [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type)
                     for v, f in zip(out, target)], schema=target)
        del work
        give_back()

    return narrow.mapInArrow(run, full)
