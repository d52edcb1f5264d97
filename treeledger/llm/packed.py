"""Exchange of many small keyed values as a few binary blobs.

A mapper sorts 64-bit keys with numpy and writes one row per (slice of input, part); a part is a range of key values, so
equal keys meet in one part.  Rows hold some kilobytes each, which keeps the cost of Spark's row format and of the JVM's
sort away from values of a few bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Rows that go to a Python worker at once; a batch and its copies on both sides take so many texts of memory.
BATCH_ROWS = 2000


def release() -> None:
    """Gives what a task has freed back to the machine: workers are used again by other stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """frame.mapInArrow(run, schema) in batches of at most BATCH_ROWS rows (a setting of the session, lowered if it is
    larger), after which the worker gives memory back."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return frame.mapInArrow(tidy, schema)


def fresh(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def n_parts(spark: SparkSession) -> int:
    """As many parts as the session has shuffle partitions: the setting that follows the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of key values begins in sorted keys, and the end."""
    edge = np.array([-(-(k << 32) // n) << 32 for k in range(1, n)], U64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]]).astype(np.int64)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane: the high planes are nearly all zero and compress."""
    d = np.diff(keys, prepend=U64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def planes(values: np.ndarray, kind: str) -> bytes:
    v = np.ascontiguousarray(values, dtype=kind)
    return v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def deal(blobs: DataFrame, n: int) -> DataFrame:
    """Brings the rows of each part (column part, 0 to n - 1) into one partition of their own."""
    return blobs.repartitionById(n, "part")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
