"""Shared helpers of the training-data operators: tables, scratch tables,
batch sizes and chunked access to Arrow text."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path, ship_package

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK_BYTES = 1 << 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``put`` writes and rereads a table, so a lost executor never recomputes
    what came before it; ``drop`` frees a table once nothing reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def free(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now;
        otherwise they stay until the driver happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch while wide binary rows pass to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind, count=len(column) + 1 + column.offset)[column.offset:]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offs.astype(np.int64)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` with their bytes and offsets from 0, about ``limit``
    bytes at a time (a longer text comes alone and whole)."""
    if len(column) == 0:
        return
    data, offs = string_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 20_000)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def binary_column(blob: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows from one byte array and its offsets (first offset 0)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1,
                                 [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(blob.tobytes())]
                                 ).cast(pa.binary())


def crc_of_id(column: Column) -> Column:
    """crc32 of an identifier written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
