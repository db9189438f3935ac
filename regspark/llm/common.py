"""Helpers that the operators share: table access, bounded Arrow batches, shared-folder tables."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Bound what one Arrow batch holds, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage and computes df once; a lost executor costs a reread.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker process, kept from task to task."""
    module = sys.modules.get("_regspark_worker")
    if module is None:
        module = sys.modules["_regspark_worker"] = types.ModuleType("_regspark_worker")
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Python tuples of the named columns, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def utf8_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def empty_if_null(text: str = "text"):
    return F.coalesce(F.col(text), F.lit("")).alias(text)
