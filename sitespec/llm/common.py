"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitespec.schemas import materialize, shared_folder

__all__ = ["fresh_folder", "materialize", "nonce", "release_memory", "shared_folder", "table", "text_batches", "whole_text"]


#: Rows and bytes that go to a Python worker at a time; whole texts can be long, so these are fewer than Spark's default.
BATCH_ROWS, BATCH_BYTES = 250, 1 << 20


def text_batches(spark: SparkSession) -> None:
    """Let tasks hand whole texts to Python in small batches; settings of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with small batches for what runs over it."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/sitespec-{uuid.uuid4().hex}/{name}"


def nonce() -> str:
    """A name that no other attempt uses."""
    return uuid.uuid4().hex


def release_memory() -> None:
    """Give what a worker process has freed back to the system: workers outlive their tasks and wait for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others have no such call
    if trim:
        trim(0)
