"""Session settings, shared tables and Arrow plumbing for the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from triplewright.storage import discard, small_table, stored  # noqa: F401

def session(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, in rows and bytes, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that this worker has freed back to the system: an idle worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with numpy's wrap-around arithmetic unannounced."""

    def run(batches):
        try:
            with np.errstate(over="ignore"):
                yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def crc_fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``: a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")
