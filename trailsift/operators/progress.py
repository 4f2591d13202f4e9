"""Page progress: fold batch results, rebuild the frontier, choose the next page; streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.operators.catalog import missing_numbers
from trailsift.plans import ordered

DEFAULT_LAST_PAGE = 200  # fixed value


def max_reasonable_page(target: int | None = None, fallback: int = 1) -> int:
    """Fixed rule: target/25 + 20 where a target is known, else 200."""
    return DEFAULT_LAST_PAGE if target is None else max(fallback, target // 25 + 20)


def bound_page(page: Column, index: Column, limit: int, fallback: int = 1) -> tuple[Column, Column]:
    """Page and index, set back to the fallback page when the page is out of reason."""
    over = page > limit
    return F.when(over, F.lit(fallback)).otherwise(page), F.when(over, F.lit(0)).otherwise(index)


def transition() -> tuple[Column, Column, Column]:
    """(status, next_index, opens the next page) that one batch result leads to."""
    reached = F.greatest(F.lit(0), F.col("start_index") + F.col("processed")).cast("bigint")
    none_new = (F.col("processed") > 0) & (F.col("downloaded") == 0)
    whole = (F.col("total_found") > 0) & (reached >= F.col("total_found"))
    blocked = none_new & (F.col("errors") > 0)
    dry = none_new & (F.col("skipped") >= F.col("processed"))
    status = F.when(whole, "done").when(blocked, "blocked").when(dry, "done").otherwise("in_progress")
    index = F.when(whole, F.lit(0)).when(blocked, reached).when(dry, F.lit(0)).otherwise(reached)
    return status, index.cast("bigint"), status != "in_progress"


def fold_batches(batches: DataFrame) -> DataFrame:
    """State of each page after its batch results in ``pos`` order.

    Counts add up and the last batch decides the status, so the fold is one aggregate that combines
    before the shuffle.  A finished page opens the following one as pending.
    """
    status, index, opens = transition()
    marked = batches.withColumn("status", status).withColumn("next_index", index).withColumn("opens", opens)
    pages = marked.groupBy("page").agg(
        F.count("*").alias("attempts"),
        F.sum("downloaded").alias("downloaded_count"),
        F.sum("skipped").alias("skipped_count"),
        F.sum("errors").alias("error_count"),
        F.max_by(F.struct("status", "next_index"), "pos").alias("last"),
        F.max("opens").alias("opened"),
    )
    seen = pages.select("page", "attempts", "downloaded_count", "skipped_count", "error_count", "last.status", "last.next_index")
    following = pages.where("opened").select((F.col("page") + 1).alias("page")).join(seen.select("page"), "page", "left_anti")
    zero = F.lit(0).cast("bigint")
    opened = following.select(
        "page", zero.alias("attempts"), zero.alias("downloaded_count"), zero.alias("skipped_count"),
        zero.alias("error_count"), F.lit("pending").alias("status"), zero.alias("next_index"),
    )
    return seen.unionByName(opened)


def _pages_with_records(records: DataFrame) -> DataFrame:
    return records.select(F.col("source_page").try_cast("bigint").alias("page")).where("page >= 1").distinct()


def reconcile_frontier(records: DataFrame, progress: DataFrame, max_page: int) -> DataFrame:
    """Pages after the repair: those below the frontier with records are done, gaps become pending,
    the frontier itself is in progress.  Finished and blocked pages stay.  No source page, no change.

    Pages with records beyond ``max_page`` are out of reason: they keep their status and are flagged ``beyond``.
    """
    every = _pages_with_records(records)
    have = every.where(F.col("page") <= max_page)
    frontier = have.agg(F.max("page")).scalar()
    gaps = missing_numbers(have, "page", frontier)
    known = every.withColumn("has", F.lit(True)).unionByName(gaps.withColumn("has", F.lit(False)))
    both = progress.select("page", F.col("status").alias("old"), F.col("next_index").alias("old_index")).join(
        known, "page", "full_outer"
    )
    old = F.col("old")
    terminal = F.coalesce(old.isin("done", "blocked"), F.lit(False))
    held = F.coalesce(old.isin("done", "blocked", "in_progress", "pending"), F.lit(False))
    healed = F.coalesce("has", F.lit(False)) & ~terminal & (F.col("page") < frontier)
    at_front = F.coalesce("has", F.lit(False)) & ~terminal & (F.col("page") == frontier)
    gap = F.coalesce(~F.col("has"), F.lit(False)) & ~held & (F.col("page") < frontier)
    reset = healed | at_front
    beyond = F.coalesce("has", F.lit(False)) & (F.col("page") > max_page)
    return both.select(
        "page",
        F.when(healed, "done").when(at_front, "in_progress").when(gap, "pending").otherwise(old).alias("status"),
        F.when(reset, F.lit(0)).otherwise(F.coalesce("old_index", F.lit(0))).cast("bigint").alias("next_index"),
        F.coalesce(healed, F.lit(False)).alias("healed"), F.coalesce(gap, F.lit(False)).alias("gap"), beyond.alias("beyond"),
    )


def frontier_summary(reconciled: DataFrame, records: DataFrame, max_page: int) -> DataFrame:
    """frontier, healed pages, pages with records, gap pages, pages beyond reason; no row when no record names a page."""
    near = F.col("page") <= max_page
    have = _pages_with_records(records).agg(
        F.max(F.when(near, F.col("page"))).alias("frontier"), F.count_if(near).alias("pages_with_records"), F.count_if(~near).alias("pages_beyond")
    )
    counts = reconciled.agg(F.count_if("healed").alias("healed_pages"), F.count_if("gap").alias("gap_pages"))
    return have.select(
        "frontier", counts.select("healed_pages").scalar().alias("healed_pages"), "pages_with_records",
        counts.select("gap_pages").scalar().alias("gap_pages"), "pages_beyond",
    ).where("frontier IS NOT NULL")


def next_page(progress: DataFrame, max_page: int, fallback: int = 1) -> DataFrame:
    """The page to work on: one in progress first, else the lowest open one, else the one after the last."""
    status = F.coalesce("status", F.lit("pending"))
    open_page = status.isin("in_progress", "pending", "failed") & (F.col("page") <= max_page)
    closed = status.isin("done", "blocked") & (F.col("page") <= max_page)
    best = F.min(F.when(open_page, F.struct((status != "in_progress").alias("later"), F.col("page"), F.coalesce("next_index", F.lit(0)).alias("i"))))
    after = F.coalesce(F.max(F.when(closed, F.col("page"))), F.lit(fallback - 1)) + 1
    row = progress.agg(best.alias("best"), after.alias("after"))
    wrapped = F.when(F.col("after") > max_page, F.lit(fallback)).otherwise(F.col("after"))
    return row.select(
        F.coalesce("best.page", wrapped).cast("bigint").alias("page"), F.coalesce("best.i", F.lit(0)).cast("bigint").alias("next_index")
    )


def block_far_pages(progress: DataFrame, max_page: int) -> DataFrame:
    """Open pages beyond reason are blocked."""
    far = (F.col("page") > max_page) & ~F.coalesce(F.col("status").isin("blocked", "done"), F.lit(False))
    return progress.withColumn("status", F.when(far, "blocked").otherwise(F.col("status")))


# ---- streaks --------------------------------------------------------------------------------------


def round_delta(rounds: DataFrame, keys: list[str], order: str, total: str, target: int) -> DataFrame:
    """before, after, delta, remaining and completed per round of a running total."""
    seen = ordered.previous(rounds, keys, [order], ordered.position_block(order), {"before": F.col(total)})
    before = F.coalesce("before", F.lit(0))
    return (
        seen.withColumn("delta", F.col(total) - before)
        .withColumn("before", before)
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(target) - F.col(total)))
        .withColumn("completed", F.col(total) >= target)
    )


def streak(rows: DataFrame, keys: list[str], order: str, hit: Column, out: str) -> DataFrame:
    """Consecutive rows up to this one where ``hit`` holds; 0 where it does not."""
    miss = ~F.coalesce(hit, F.lit(False))
    run = ordered.scan(
        ordered.number_rows(rows, keys, [order], ordered.position_block(order), "__n"),
        keys, [order], ordered.position_block(order),
        [ordered.Scan("__miss", "max", F.when(miss, F.col("__n")))],
    )
    return run.withColumn(out, F.col("__n") - F.coalesce("__miss", F.lit(0))).drop("__n", "__miss")


def backoff(rows: DataFrame, keys: list[str], order: str, delta: str, base: int, highest: int, limit: int) -> DataFrame:
    """Rounds without progress in a row, the pause they cost, and whether to stop."""
    counted = streak(rows, keys, order, F.col(delta) <= 0, "idle_rounds")
    power = F.pow(F.lit(2.0), F.least(F.col("idle_rounds") - 1, F.lit(60)))
    pause = F.when(F.col("idle_rounds") > 0, F.least(F.lit(base) * power, F.lit(highest))).otherwise(F.lit(0))
    return counted.withColumn("pause", pause.cast("bigint")).withColumn("stop", F.col("idle_rounds") >= limit)


def monotone_index(rows: DataFrame, keys: list[str], order: str, requested: str) -> DataFrame:
    """Start index that never moves back: the largest one asked for so far."""
    return ordered.scan(
        rows, keys, [order], ordered.position_block(order), [ordered.Scan("effective", "max", F.col(requested))]
    )
