"""Structured Streaming forms of the operators.

Sinks write one folder per micro-batch, named by the batch id, so a batch that runs twice after a
lost executor or driver replaces its own output.  State is bounded by a watermark or by a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.operators import progress as pr
from trailsift.operators import usage as us
from trailsift.streaming import keyed

# ---- sources and sinks -------------------------------------------------------------------------------


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON-line files of a folder tree.  The writer rolls files; a growing file is not followed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option(
        "recursiveFileLookup", "true"
    ).json(folder)


def records_stream(spark: SparkSession, folder: str, fields: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records of new files; lines that are no JSON objects are left out, as by a tolerant reader."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(folder)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return lines.where(is_object).select(F.from_json("value", fields).alias("r")).select("r.*")


NETWORK_EVENTS = (
    "event string, request_id string, frame_id string, at double, url string, type string, size bigint, name string, pos bigint"
)


def network_events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return json_stream(spark, folder, NETWORK_EVENTS, files_per_trigger)


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Log lines of new files with their file."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(folder).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")
    )


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over everything there is and give back what the batches wrote (with ``batch``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    drain_with(stream, path, write, mode)
    return stream.sparkSession.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def drain_with(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key in an update-mode output."""
    others = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*keys, "s.*")


# ---- operators -----------------------------------------------------------------------------------------


def dedup_seen(articles: DataFrame, time: str, delay: str) -> DataFrame:
    """The first article per address hash among those at most ``delay`` apart; older hashes are forgotten."""
    hashed = articles.withColumn("hash", F.md5("url"))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def usage_stream(usage: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Usage summary per model, kept up to date per micro-batch."""
    return us.price_usage(usage, prices, aliases).groupBy("model").agg(*us.usage_measures())


def page_progress_stream(batches: DataFrame) -> DataFrame:
    """State of each page after the batch results so far (update mode).

    Sums and the result of the last batch by ``pos``: an incremental aggregate, no custom state.
    """
    status, index, _ = pr.transition()
    marked = batches.withColumn("status", status).withColumn("next_index", index)
    return marked.groupBy("page").agg(
        F.count("*").alias("attempts"), F.sum("downloaded").alias("downloaded_count"),
        F.sum("skipped").alias("skipped_count"), F.sum("errors").alias("error_count"),
        F.max_by(F.struct("status", "next_index"), "pos").alias("last"),
    ).select("page", "attempts", "downloaded_count", "skipped_count", "error_count", "last.status", "last.next_index")


def _timed(events: DataFrame, delay: str) -> DataFrame:
    at = F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))
    return events.where("request_id IS NOT NULL").withColumn("time", at).withWatermark("time", delay)


def timeout_stream(events: DataFrame, threshold_seconds: float, delay: str = "10 seconds") -> DataFrame:
    """A row for every request that was active for the threshold, once.

    Only starts and ends count, so a session of the request id with the threshold as its gap holds both
    if the request ended in time; a session that closes with a start and no end has timed out.
    """
    is_start = F.col("event") == "requestWillBeSent"
    marks = events.where(F.col("event").isin("requestWillBeSent", "loadingFinished", "loadingFailed"))
    gap = f"{int(threshold_seconds * 1000)} milliseconds"
    sessions = _timed(marks, delay).groupBy("request_id", F.session_window("time", gap)).agg(
        F.max_by("url", F.when(is_start, F.col("pos"))).alias("url"), F.max(F.when(is_start, F.col("pos"))).alias("__start"),
        F.max(F.when(~is_start, F.col("pos"))).alias("__end"),
    )
    return sessions.where("__start IS NOT NULL AND (__end IS NULL OR __end < __start)").select("request_id", "url")


def import_stream(records: DataFrame, files: DataFrame, path: str, images: DataFrame | None = None) -> DataFrame:
    """Run the import over everything there is; gives back the changes of all batches so far (with ``batch``).

    A batch writes only its own changes, under its id, and reads nothing that is stored: a replay changes nothing.
    """
    return drain(keyed.import_changes(records, files, images), path)
