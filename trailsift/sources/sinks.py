"""Files written for people and for other programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.functions import trace as tr
from trailsift.operators import catalog as ca
from trailsift.operators import queue as qu

INFO_COLUMNS = ["sequence", "file_name", "title", "collection_title", "page_url", "image_url", "evidence", "metadata", "summary"]


def append_records(records: DataFrame, path: str) -> None:
    """Append JSON lines, non-ASCII text as it is."""
    records.write.mode("append").json(path)


def info_lines(records: DataFrame, columns: Sequence[str] = INFO_COLUMNS) -> DataFrame:
    """Markdown table rows of the downloaded records, in sequence order."""
    cells = [tx.markdown_cell(F.col(c)) for c in columns if c in records.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return ca.downloaded(records).orderBy(*ca.record_order()).select(row.alias("value"))


def write_info_table(records: DataFrame, path: str, columns: Sequence[str] = INFO_COLUMNS) -> None:
    """The table as text: a header file, then range-sorted parts whose names keep the order."""
    shown = [c for c in columns if c in records.columns]
    head = records.sparkSession.createDataFrame(
        [("| " + " | ".join(shown) + " |",), ("|" + "---|" * len(shown),)], "value string"
    )
    head.coalesce(1).write.mode("overwrite").text(f"{path}/00-head")
    info_lines(records, columns).write.mode("overwrite").text(f"{path}/01-rows")


def report_lines(validation: DataFrame) -> DataFrame:
    """Validation report, one line per fact, with a place to sort by."""
    facts = [
        ("target_reached", F.col("complete").cast("string")), ("downloaded_records", F.col("downloaded_records").cast("string")),
        ("remaining_records_needed", F.col("remaining_records").cast("string")), ("image_files", F.col("image_files").cast("string")),
        ("sequence_gaps_warning_only", F.col("missing_sequences").cast("string")), ("bad_or_empty_images", F.col("bad_files").cast("string")),
        ("duplicate_image_hash_groups", F.col("duplicate_groups").cast("string")), ("orphan_files_warning_only", F.col("orphan_files").cast("string")),
    ]
    verdict = F.when(F.col("complete"), "SUCCESS").otherwise("INCOMPLETE")
    first = F.concat(F.lit("Final download validation: "), verdict)
    lines = [first] + [F.concat(F.lit(f"- {n}: "), v) for n, v in facts[1:]]
    return validation.select(F.posexplode(F.array(*lines)).alias("nth", "value"))


def report_details(records: DataFrame, files: DataFrame, target: int, min_bytes: int = 10 * 1024) -> DataFrame:
    """A line for each bad file, each file of a duplicate group and each missing sequence: kind, value."""
    bad = files.where(ca.bad_image(min_bytes)).select(F.lit("bad").alias("kind"), F.concat(F.lit("- bad or empty image: "), "file_name").alias("value"))
    twice = ca.duplicate_hash_groups(files).select(F.lit("duplicate").alias("kind"), F.concat(F.lit("- duplicate "), "sha256", F.lit(": "), "file_name").alias("value"))
    missing = ca.missing_numbers(ca.used_sequences(ca.downloaded(records)), "sequence", target)
    gaps = missing.select(F.lit("gap").alias("kind"), F.concat(F.lit("- missing sequence: "), F.col("sequence").cast("string")).alias("value"))
    return bad.unionByName(twice).unionByName(gaps)


def write_report(validation: DataFrame, details: DataFrame, path: str) -> None:
    """The report's few lines as one file, its details as one folder per kind."""
    report_lines(validation).orderBy("nth").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    details.write.mode("overwrite").partitionBy("kind").text(f"{path}/details")


def inventory_counts(queue: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """Counts of the inventory document: queue rows by status, files, downloaded addresses."""
    by_status = qu.queue_counts(queue).select(F.concat(F.lit("queue."), "status").alias("name"), "n")
    file_count = files.agg(F.count("*").alias("n")).select(F.lit("image_file_count").alias("name"), "n")
    done = ca.downloaded(records).agg(F.countDistinct("page_url").alias("n")).select(F.lit("downloaded_record_count").alias("name"), "n")
    return by_status.unionByName(file_count).unionByName(done)


def write_inventory(queue: DataFrame, files: DataFrame, records: DataFrame, path: str) -> None:
    """Counts, files and records as JSON parts of one folder."""
    inventory_counts(queue, files, records).coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    files.write.mode("overwrite").json(f"{path}/image_files")
    ca.downloaded(records).write.mode("overwrite").json(f"{path}/downloaded_records")


def masked_history(steps: DataFrame, secrets: list[tuple[str, str]]) -> DataFrame:
    """Steps with secrets masked inside the parameters of ``input`` actions only."""
    masked: Column = F.when(F.col("name") == "input", tr.mask_secrets(F.col("params"), secrets)).otherwise(F.col("params"))
    return steps.withColumn("params", masked)


def write_history(steps: DataFrame, path: str, secrets: list[tuple[str, str]]) -> None:
    masked_history(steps, secrets).write.mode("overwrite").json(path)


def write_har(entries: DataFrame, pages: DataFrame, path: str) -> None:
    """The parts of a log as one folder: its head, and one page or entry per line (a session has no bound on either)."""
    head = F.to_json(F.struct(F.lit("1.2").alias("version"), F.struct(F.lit("trailsift").alias("name"), F.lit("1").alias("version")).alias("creator")))
    entries.sparkSession.range(1).select(head.alias("value")).write.mode("overwrite").text(f"{path}/log")
    pages.select(F.col("page").alias("value")).write.mode("overwrite").text(f"{path}/pages")
    entries.select(F.col("entry").alias("value")).write.mode("overwrite").text(f"{path}/entries")
