"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets))


def held_out(key: Column, buckets: int, fold: int) -> Column:
    """Whether a row belongs to the held-out fold; a row without id never does."""
    return F.coalesce(id_bucket(key, buckets) == fold, F.lit(False))


def byte_slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts in ``column`` take about ``size`` bytes; one row may take more."""
    sizes = np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)), np.int64, batch.num_rows)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        limit = (ends[begin - 1] if begin else 0) + size
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Return freed memory to the system: workers stay for later tasks, and so would what Arrow and the allocator hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; not there with another library
    if trim is not None:
        trim(0)
