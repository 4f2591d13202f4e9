"""Queues of result addresses and search cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.functions import urls as u
from trailsift.plans.lookup import pick

# Which status wins when the same address is in several queues.
RANK = {"downloaded": 4, "failed": 3, "skipped": 2, "pending": 1, "in_progress": 0}


def _status(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("pending"))


def _rank(status: Column) -> Column:
    pairs = [F.lit(x) for kv in RANK.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(0))


def merge_queues(
    rows: DataFrame, item_base: str, reset_in_progress: bool = False,
    include: list[str] | None = None, exclude: list[str] | None = None,
) -> DataFrame:
    """One row per canonical address: the highest status rank wins, ties keep the earlier row.

    ``rows`` is the union of the queue files with ``file`` and ``pos``.
    """
    url = u.canonical_item_url(F.coalesce("url", F.lit("")), item_base)
    title = tx.normalize_title(F.coalesce("title", F.lit("")), url)
    status = _status(F.col("status"))
    if reset_in_progress:
        status = F.when(status == "in_progress", "pending").otherwise(status)
    shaped = rows.select(
        url.alias("url"), title.alias("title"), status.alias("status"),
        F.when(status.isin("pending", "downloaded"), F.lit(None)).otherwise(F.col("error")).alias("error"),
        "file", "pos",
    ).where("url <> ''")
    if include is not None:
        shaped = shaped.where(tx.relevant(F.col("title"), F.col("url"), include, exclude or []))
    best = F.struct(-_rank(F.col("status")), F.col("file"), F.col("pos"))
    return pick(shaped, ["url"], best, ["title", "status", "error", "file", "pos"])


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy(_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def merge_queue_status(queue: DataFrame, records: DataFrame, item_base: str) -> DataFrame:
    """Bring the queue up to date with the download records, read in ``pos`` order.

    A download overrides everything and clears the error; a failure or skip counts only without one.
    Addresses the queue lacks are added.
    """
    address = u.canonical_item_url(F.coalesce(F.nullif(F.col("page_url"), F.lit("")), F.col("url"), F.lit("")), item_base)
    r = records.select(
        address.alias("url"), "pos", "status", tx.normalize_title(F.coalesce("title", F.lit("")), address).alias("title"),
        F.nullif("error", F.lit("")).alias("error"),
    ).where("url <> ''")
    is_done = F.col("status") == "downloaded"
    is_miss = F.col("status").isin("failed", "skipped")
    facts = r.groupBy("url").agg(
        F.max_by("title", F.when(is_done, F.col("pos"))).alias("done_title"),
        F.max(is_done).alias("done"),
        F.max_by("status", F.when(is_miss, F.col("pos"))).alias("miss"),
        F.max_by("error", F.when(is_miss & F.col("error").isNotNull(), F.col("pos"))).alias("miss_error"),
        F.min_by("title", "pos").alias("first_title"),
    )
    q = queue.select("url", F.col("title").alias("q_title"), F.col("status").alias("q_status"), F.col("error").alias("q_error"))
    both = q.join(facts, "url", "full_outer")
    done = F.coalesce("done", F.lit(False))
    kept = F.coalesce(F.col("q_status"), F.lit("pending")) == "downloaded"
    return both.select(
        "url",
        F.when(done, F.col("done_title")).otherwise(F.coalesce("q_title", "first_title")).alias("title"),
        F.when(done, "downloaded").when(kept, "downloaded").otherwise(F.coalesce("miss", "q_status", F.lit("pending"))).alias("status"),
        F.when(done, F.lit(None)).when(kept, F.col("q_error")).otherwise(F.coalesce("miss_error", "q_error")).alias("error"),
    )


def collect_queue(queue: DataFrame, results: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """The queue and the relevant results it lacks, as pending; the first of equal addresses counts."""
    fresh = results.where((F.col("url") != "") & tx.relevant(F.col("title"), F.col("url"), include, exclude))
    first = pick(fresh, ["url"], F.col("pos"), ["title", "pos"])
    new = first.join(queue.select("url"), "url", "left_anti").withColumn("status", F.lit("pending"))
    return queue.unionByName(new, allowMissingColumns=True)


def next_pending(queue: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` pending rows in order, as in progress."""
    return (
        queue.where(_status(F.col("status")) == "pending").orderBy("pos").limit(n)
        .withColumn("status", F.lit("in_progress")).withColumn("error", F.lit(None).cast("string"))
    )


def claim_pending(queue: DataFrame, n: int = 1) -> DataFrame:
    """The whole queue after ``next_pending``."""
    taken = next_pending(queue, n).select("pos", F.lit(True).alias("__taken"))
    marked = queue.join(taken, "pos", "left")
    return marked.withColumn("error", F.when(F.col("__taken"), F.lit(None)).otherwise(F.col("error"))).withColumn(
        "status", F.when(F.col("__taken"), "in_progress").otherwise(_status(F.col("status")))
    ).drop("__taken")


def processed_set(done: DataFrame, records: DataFrame) -> DataFrame:
    """Normalised addresses that a cursor or a record marks as done."""
    a = done.select(u.normalize_url(F.col("url")).alias("address"))
    b = records.where(F.coalesce("page_url", F.lit("")) != "").select(u.normalize_url(F.col("page_url")).alias("address"))
    return a.unionByName(b).distinct()


def next_item(items: DataFrame, processed: DataFrame) -> DataFrame:
    """Per result page: the first unprocessed item in page order, counts, and whether the page is done."""
    keyed = items.where(F.coalesce("url", F.lit("")) != "").withColumn("address", u.normalize_url(F.col("url")))
    marked = keyed.join(processed.withColumn("__hit", F.lit(True)), "address", "left")
    is_open = F.col("__hit").isNull()
    return marked.groupBy("page").agg(
        F.min_by("url", F.when(is_open, F.col("index"))).alias("next_url"),
        F.coalesce(F.min(F.when(is_open, F.col("index"))), F.lit(-1)).alias("next_index"),
        F.count("*").alias("total_found"),
        F.count_if(~is_open).alias("processed_count"),
        (~F.max(is_open)).alias("page_done"),
    )
