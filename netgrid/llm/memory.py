"""What a Python worker holds on to between tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch between Spark and a Python worker.
BATCH = 2 << 20


def trim() -> None:
    """Hand free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """A function of Arrow batches that ends with ``trim``, so that later stages find the memory of its task."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def small_batches(spark: SparkSession) -> None:
    """Let the session's batches to Python workers hold BATCH bytes at most; a smaller setting stays.

    Spark's own bound is 64 MB, of which each task holds several at a time.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = re.match(r"\d+", spark.conf.get(name))
    if not digits or not 0 < int(digits[0]) <= BATCH:
        spark.conf.set(name, str(BATCH))
