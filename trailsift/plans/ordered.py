"""Order-dependent operators that never put a whole group into one task.

A plain window over ``PARTITION BY key`` runs each key in one task, so a key
that holds a third of the rows holds up the job.  Here every key is cut into
*blocks* of its order (a time slice or a range of positions).  Windows run per
``(key, block)``; each block is then reduced to one summary row, the summaries
are scanned per key, and the carried value is joined back.  Both the window
and the join use the ``(key, block)`` partitioning, so the wide rows are
shuffled once.  The result equals the plain window whatever the block size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
DEFAULT_BLOCK_ROWS = 1 << 16
MOST_TEXT_BLOCKS = 512
SAMPLED_PER_BLOCK = 100  # rows of the sample that finds the boundaries of text blocks


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, max, min or last (last non-null).

    ``before`` leaves out the current row, which turns ``last`` into a lag.
    """

    out: str
    kind: str
    value: Column
    before: bool = False


def position_block(column: str, rows: int = DEFAULT_BLOCK_ROWS) -> Column:
    """Blocks of ``rows`` neighbouring integer positions."""
    return F.expr(f"`{column}` div {rows}")


def time_block(column: str, seconds: int = 3600) -> Column:
    """Blocks of a time slice."""
    return F.expr(f"unix_seconds(cast(`{column}` AS timestamp)) div {seconds}")


def text_block(df: DataFrame, column: str, rows: int = DEFAULT_BLOCK_ROWS) -> Column:
    """Blocks of about ``rows`` neighbouring strings, between boundaries drawn from a bounded sample."""
    total = df.count()
    blocks = min(MOST_TEXT_BLOCKS, 1 + total // rows)
    if blocks == 1:
        return F.lit(0).cast("bigint")
    share = min(1.0, blocks * SAMPLED_PER_BLOCK / total)
    names = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).sample(share, seed=7).collect())
    bounds = sorted({names[k * len(names) // blocks] for k in range(1, blocks)}) if names else []
    before = F.filter(F.lit(bounds).cast("array<string>"), lambda bound: bound <= F.col(column))
    return F.coalesce(F.size(before), F.lit(0)).cast("bigint")


def _aggregate(kind: str, column: Column, ordinal: str) -> Column:
    if kind == "sum":
        return F.sum(column)
    if kind == "max":
        return F.max(column)
    if kind == "min":
        return F.min(column)
    return F.max_by(column, F.when(column.isNotNull(), F.col(ordinal)))


def _running(kind: str, column: Column) -> Column:
    if kind == "sum":
        return F.sum(column)
    if kind == "max":
        return F.max(column)
    if kind == "min":
        return F.min(column)
    return F.last(column, ignorenulls=True)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    scans: Sequence[Scan],
) -> DataFrame:
    """Add running values over ``order`` within ``keys``.

    ``block`` (any orderable type) must not decrease along ``order``; ``order`` must be unique
    within a key.  Rows keep all their columns.
    """
    keys = list(keys)
    order = list(order)
    ordinal = "__local_ordinal"
    # Keys and block are one struct column.  Null keys are equal inside a struct, so a plain equi join
    # does, and window and join share one partitioning and one sort: the wide rows move once.
    inner = Window.partitionBy(BLOCK).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inner.rowsBetween(Window.unboundedPreceding, -1)

    local = df.withColumn(BLOCK, F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], block.alias("b")))
    for i, s in enumerate(scans):
        local = local.withColumn(f"__v{i}", s.value)
    summary = local.select(BLOCK, *[f"__v{i}" for i in range(len(scans))], F.struct(*order).alias(ordinal)).groupBy(BLOCK).agg(
        *[_aggregate(s.kind, F.col(f"__v{i}"), ordinal).alias(f"__s{i}") for i, s in enumerate(scans)]
    )
    outer = (
        Window.partitionBy(*[F.col(BLOCK)[f"k{n}"] for n in range(len(keys))])
        .orderBy(F.col(BLOCK)["b"]).rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = summary.select(
        BLOCK, *[_running(s.kind, F.col(f"__s{i}")).over(outer).alias(f"__c{i}") for i, s in enumerate(scans)]
    )
    for i, s in enumerate(scans):
        local = local.withColumn(f"__l{i}", _running(s.kind, F.col(f"__v{i}")).over(ahead if s.before else upto))
    joined = local.join(carries, BLOCK, "left")
    drop = [BLOCK]
    for i, s in enumerate(scans):
        joined = joined.withColumn(s.out, _combine(s.kind, F.col(f"__c{i}"), F.col(f"__l{i}")))
        drop += [f"__v{i}", f"__l{i}", f"__c{i}"]
    return joined.drop(*drop)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "ordinal"
) -> DataFrame:
    """Dense 1-based ordinal within ``keys``: ``row_number`` without the one-task group."""
    return scan(df, keys, order, block, [Scan(out, "sum", F.lit(1).cast("bigint"))])


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, columns: dict[str, Column]
) -> DataFrame:
    """``lag(…, 1)`` for each ``{out: value}``, nulls included."""
    scans = [Scan("__previous", "last", F.struct(*[c.alias(n) for n, c in columns.items()]), before=True)]
    out = scan(df, keys, order, block, scans)
    return out.select("*", *[F.col("__previous")[n].alias(n) for n in columns]).drop("__previous")


def island_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    starts: Column,
    out: str = "island_row",
) -> DataFrame:
    """1-based position since the last row where ``starts`` holds (0 before the first start)."""
    numbered = number_rows(df, keys, order, block, "__n")
    marked = scan(
        numbered, keys, order, block, [Scan("__start", "max", F.when(starts, F.col("__n")))]
    )
    return marked.withColumn(
        out, F.when(F.col("__start").isNull(), F.lit(0)).otherwise(F.col("__n") - F.col("__start") + 1)
    ).drop("__n", "__start")


def rolling_list(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    size: int,
    out: str,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """The last ``size`` values up to each row, oldest first.

    Rows are numbered first; blocks of the dense number then need a halo of
    exactly ``size - 1`` rows, which are copied into the following block.
    """
    keys = list(keys)
    block_rows = max(block_rows, size)
    numbered = number_rows(df, keys, order, block, "__n").withColumn("__value", value)
    home = F.expr(f"(__n - 1) div {block_rows}")
    in_halo = ((F.col("__n") - 1) % block_rows) >= block_rows - (size - 1)
    spread = numbered.withColumn("__home", home).withColumn(
        "__target", F.explode(F.when(in_halo, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    w = Window.partitionBy(*keys, "__target").orderBy("__n").rowsBetween(-(size - 1), 0)
    return (
        spread.withColumn(out, F.collect_list("__value").over(w))
        .where(F.col("__home") == F.col("__target"))
        .drop("__n", "__value", "__home", "__target")
    )
