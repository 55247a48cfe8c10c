"""What the operators of this subpackage share: table access, partition counts, the shared folder."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.session import shared_dir, written

__all__ = ["FOLDS", "buckets", "fold", "held_out", "lean", "parts", "shared_dir", "table", "written"]

#: The share of rows that no model learns from: crc32(doc_id as text) mod FOLDS = 0.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """How many buckets a shuffle has: the session's own setting, which grows with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, groups: int) -> int:
    """How many groups packed arrays are dealt to: a task works on one of them at a time.

    They grow with the session's partitions. 24 bits of a hash choose one of them, so that is their limit.
    """
    return min(groups * parts(spark), 1 << 24)


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that no model learns from; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fold(doc_id: int | None) -> int:
    """The same fold in Python; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _give_back() -> None:
    """Memory that was freed but is still held goes back to the machine, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for workers that are used again: a task neither inherits nor leaves memory that is only held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
