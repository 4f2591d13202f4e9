"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

# Rows of an Arrow batch that are worked on together.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and row ids stay as they are."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What a Python worker keeps from task to task, by the operator that uses it.
KEPT: dict[str, object] = {}


def pieces(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, user: str = "") -> Iterator[pa.RecordBatch]:
    """Short pieces of Arrow batches, for work that keeps more in memory than a batch; Spark bounds the bytes of a batch itself.

    A worker that goes on to another operator forgets what it kept for the last one.
    """
    for other in [name for name in KEPT if name != user]:
        del KEPT[other]
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ..., so that names of any kind can't clash with an operator's own."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place_of(df: DataFrame, column: str) -> str:
    """The name that ``column`` has in ``positional(df)``."""
    return f"c{df.columns.index(column)}"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
