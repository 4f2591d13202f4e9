"""Lookups and first/last-by-order picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def narrowed(big: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``big`` whose key is among ``few``.

    No hint: the runtime plan measures the distinct keys in bytes and broadcasts them if they are small.
    """
    return big.join(few.select(*on).distinct(), list(on), "left_semi")


def pick(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    An aggregate, not ``row_number() = 1``: it combines before the shuffle,
    so a hot key sends one row per map task.
    """
    chosen = (F.max_by if last else F.min_by)(F.struct(*columns), order)
    return df.groupBy(*keys).agg(chosen.alias("__picked")).select(*keys, "__picked.*")


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is never broadcast, for sides that grow with the pages.

    The planner knows a stored node table by the size of its files only.  Pages alike are a hundredth of their size there, so sides of
    hundreds of MB would pass for small ones and be gathered in the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores where the input has fewer splits than there are cores.

    For costly per-row work on a few splits that would leave cores idle.  An input with a split for every core stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
