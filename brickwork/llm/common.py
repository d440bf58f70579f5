"""What the corpus operators share: written tables, Arrow maps over texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.workspace import new_path, written  # noqa: F401


def free_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_slices(batch: pa.RecordBatch, index: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``max_bytes`` of text each (one row at least)."""
    column = batch.column(index)
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * max_bytes / max(1, column.nbytes)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, texts go to Python in batches of few rows, unless the session has its own setting: a batch is held by both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":  # Spark's default
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_texts(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for a table that Python makes from whole texts."""
    with small_batches(df.sparkSession):
        return written(df, name)


def release_memory() -> None:
    """Give freed memory back: Spark keeps Python workers for later tasks, whose memory counts beside the next ones'."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_text_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """``df`` and new columns from its text, Arrow batch by batch.

    ``make`` runs once in each task and gives a function from a list of texts
    (None for null) to one list or array per field. All other columns pass
    through untouched. Names must not clash; see :func:`free_name`.
    """
    schema = T.StructType(df.schema.fields + fields)
    index = df.columns.index(text_col)
    types = list(to_arrow_schema(T.StructType(fields)).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in text_slices(batch, index):
                found = work(part.column(index).to_pylist())
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(part.columns + arrays, names=schema.names)
                del found, arrays
        del work
        release_memory()

    return df.mapInArrow(run, schema)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def integer(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())
