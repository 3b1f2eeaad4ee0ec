"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from grainery.sources.shared import discard, materialize, new_path, shared_folder

__all__ = ["discard", "materialize", "new_path", "shared_folder"]

#: Bytes of text that Python code works on at once; one longer text is taken alone.
SLICE_BYTES = 4 << 20

#: Rows that Spark sends to Python at once, where the session does not say.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1250

#: A table up to this many bytes may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Send texts to Python some megabytes at a time: Spark's default of 10,000 rows a batch grows with their length.

    A setting of the session's own prevails.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def trimmed(work: Callable) -> Callable:
    """The same for a function of one group."""

    @functools.wraps(work)
    def run(*args, **kwargs):
        try:
            return work(*args, **kwargs)
        finally:
            trim()

    run.__signature__ = inspect.signature(work)  # Spark counts the arguments
    return run


def column_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column (`row.text`)."""
    head, *rest = path.split(".")
    arr = batch.column(head)
    for name in rest:
        arr = pc.struct_field(arr, name)
    return arr


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and stages follow one another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """A function over the batches of a task that trims memory at the task's end."""

    @functools.wraps(work)
    def run(batches, *args, **kwargs):
        try:
            yield from work(batches, *args, **kwargs)
        finally:
            trim()

    return run


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `most` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(column_of(batch, column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.maximum(np.cumsum(sizes) - 1, 0) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def strings(arr: pa.Array) -> list[str]:
    """The Python strings of an array without nulls, many at a time."""
    return arr.to_numpy(zero_copy_only=False).tolist()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(column_of(batch, column), "").to_pylist()


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each [offsets[i], offsets[i + 1])."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
