"""Helpers shared by the training-data operators: table scans, row keys and bounded Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushline.session import stored

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a text column; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds at most ``limit`` bytes of ``column``, or one row if that is longer."""
    for batch in batches:
        ends = np.cumsum(np.diff(offsets(batch.column(column))))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives what it freed back to the system: idle workers stay alive and would keep it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task


def offsets(values: pa.Array) -> np.ndarray:
    """Offsets of a binary array's values into its data buffer."""
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    kind = np.int64 if wide else np.int32
    if len(values) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def data(values: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array, one after the other."""
    at = offsets(values)
    buffer = values.buffers()[2]
    if buffer is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8)
    return np.frombuffer(buffer, np.uint8)[at[0] : at[-1]]


def totals(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between each pair of neighbouring offsets (empty ranges give 0)."""
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[at[1:] - at[0]] - running[at[:-1] - at[0]]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct ``_row``, and ``_key``: a number that no two rows share, in the order of doc_id.

    It is the doc_id itself where that tells the rows apart.  Otherwise (null or repeated ids) the rows are stored with
    numbers of their own, those without a doc_id last, so that every use of the table sees the same numbers.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        twice = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").limit(1).count()
        if not twice:
            return rows.withColumn("_key", F.col("_row.doc_id").cast("long"))
    order = F.col("_row.doc_id").asc_nulls_last(), F.xxhash64("_row.text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("_key", F.monotonically_increasing_id()), "keyed")
