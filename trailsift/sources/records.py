"""Record, log, file and history sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.plans import ordered

RECORD_FIELDS = (
    "status string, sequence string, title string, collection_title string, page_url string, image_url string, "
    "file_name string, file_path string, final_file_name string, original_file_name string, file_size bigint, sha256 string, "
    "evidence string, metadata string, summary string, source_page string, recorded_at string, downloaded_at string"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with ``file`` and the 1-based ``line_number``.

    Spark's text reader gives lines without their place.  The place is the order of Spark's own
    monotonic ids, which follow the file blocks: lines are numbered per block of the file, and the
    blocks' line counts are summed up, so a file is never one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    return ordered.number_rows(raw, ["file"], ["block", "id"], F.col("block"), "line_number").drop("block", "id")


def read_records(spark: SparkSession, path: str, fields: str = RECORD_FIELDS) -> DataFrame:
    """Tolerant JSON lines: one row per non-blank line with its ``error`` or its fields.

    ``error`` is ``line N: invalid JSON`` or ``line N: JSON value is not an object``; good rows have NULL.
    """
    lines = numbered_lines(spark, path).where(tx.strip(F.col("line")) != "")
    value = F.try_parse_json("line")
    parsed = lines.withColumn("__v", value).withColumn(
        "error",
        F.when(F.col("__v").isNull(), F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": invalid JSON")))
        .when(
            ~F.schema_of_variant("__v").startswith("OBJECT"),
            F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": JSON value is not an object")),
        ),
    )
    body = F.when(F.col("error").isNull(), F.from_json("line", fields))
    return parsed.select("file", "line_number", "error", F.when(F.col("error").isNull(), F.col("line")).alias("raw"), body.alias("r")).select(
        "file", "line_number", "error", "raw", "r.*"
    )


def good_records(rows: DataFrame) -> DataFrame:
    """The rows that are records."""
    return rows.where("error IS NULL")


def read_json_array(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Elements of JSON documents that are lists; any other document gives no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    typed = ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))
    items = F.from_json("value", f"array<struct<{typed}>>")
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    return docs.where(is_list).select("file", F.posexplode(items).alias("item_index", "item")).select("file", "item_index", "item.*")


HISTORY = (
    "history array<struct<model_output: string, result: array<struct<is_done: boolean, success: boolean, error: string, "
    "extracted_content: string>>, state: struct<url: string, title: string, interacted_element: string>, "
    "metadata: struct<step_start_time: double, step_end_time: double, step_number: int>>>"
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Steps of run-history documents, a row each; a model output that is no object is NULL."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.from_json("value", HISTORY).alias("h"))
    steps = docs.select("run", F.posexplode("h.history").alias("i", "s"))
    output = F.when(F.trim("s.model_output").startswith("{"), F.col("s.model_output"))
    last = F.try_element_at("s.result", F.lit(-1))
    return steps.select(
        "run", (F.col("i") + 1).cast("bigint").alias("step"), output.alias("model_output"),
        F.col("s.state.url").alias("url"), F.col("s.state.interacted_element").alias("interacted_element"),
        (F.col("s.metadata.step_end_time") - F.col("s.metadata.step_start_time")).alias("seconds"),
        F.try_element_at(F.filter(F.transform("s.result", lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(1)).alias("error"),
        F.coalesce(last["is_done"], F.lit(False)).alias("is_done"), last["success"].alias("success"), last["extracted_content"].alias("extracted"),
    )


def file_inventory(spark: SparkSession, folder: str, extensions: tuple[str, ...], known: DataFrame | None = None) -> DataFrame:
    """Files of a folder (not below it) with size, time and content hash.

    ``known`` (file_name, file_size, modified, sha256) spares reading files that did not change: the
    listing alone needs no content, and contents are read for the others only.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(
        F.col("path").alias("file_path"), F.regexp_replace("path", r"^.*/", "").alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content"
    )
    if known is None:
        return listed.withColumn("sha256", F.sha2("content", 256)).drop("content")
    bare = listed.drop("content")
    same = bare.join(known, ["file_name", "file_size", "modified"])
    changed = listed.join(known.select("file_name", "file_size", "modified"), ["file_name", "file_size", "modified"], "left_anti")
    return same.unionByName(changed.withColumn("sha256", F.sha2("content", 256)).drop("content"))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines in reading order: info.log, debug.log, then the backups by name; bad bytes are replaced."""
    lines = numbered_lines(spark, folder)
    name = F.regexp_replace("file", r"^.*/", "")
    rank = F.when(name == "info.log", "0").when(name == "debug.log", "1").otherwise(F.concat(F.lit("2"), F.col("file")))
    return lines.withColumn("line", F.make_valid_utf8("line")).withColumn("file_rank", rank)


LOG_SEQUENCE = r"(?i)(?:已下载并记录图片|已记录图片)\s*#(\d+):\s*([^,\s]+)"
LOG_FIELDS = r"(?i)\bsequence:\s*(\d+)\b.*?\bfile_name:\s*([^,\s]+)"
LOG_IMAGE = r"(?i)(?:图片 URL|image_url):\s*(https?://\S+)"
LOG_PAGE = r"(?i)(?:页面 URL|page_url):\s*(https?://\S+)"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^[`\"',;；，]+|[`\"',;；，]+$", "")


def log_carry_forward(lines: DataFrame) -> DataFrame:
    """Recovered (sequence, file_name, page_url, image_url): each address belongs to the last ``#sequence``
    named before it, the last address per sequence wins.

    The sequence is carried along the log by an ordered scan over blocks of lines.
    """
    def first(group: int) -> Column:
        a, b = F.regexp_extract("line", LOG_SEQUENCE, group), F.regexp_extract("line", LOG_FIELDS, group)
        return F.nullif(F.when(a != "", a).otherwise(b), F.lit(""))

    marked = lines.select(
        "file_rank", "line_number", first(1).try_cast("bigint").alias("__seq"), _unquoted(first(2)).alias("__file"),
        F.nullif(_unquoted(F.regexp_extract("line", LOG_IMAGE, 1)), F.lit("")).alias("image_url"),
        F.nullif(_unquoted(F.regexp_extract("line", LOG_PAGE, 1)), F.lit("")).alias("page_url"),
    ).where("__seq IS NOT NULL OR image_url IS NOT NULL OR page_url IS NOT NULL")
    block = F.struct("file_rank", ordered.position_block("line_number"))
    carried = ordered.scan(marked, [], ["file_rank", "line_number"], block, [ordered.Scan("sequence", "last", F.col("__seq"))])
    order = F.struct("file_rank", "line_number")
    return carried.where("sequence IS NOT NULL").groupBy("sequence").agg(
        F.max_by(F.regexp_replace("__file", r"^.*/", ""), F.when(F.col("__file").isNotNull(), order)).alias("file_name"),
        F.max_by("page_url", F.when(F.col("page_url").isNotNull(), order)).alias("page_url"),
        F.max_by("image_url", F.when(F.col("image_url").isNotNull(), order)).alias("image_url"),
    )


def pricing_snapshot(spark: SparkSession, folder: str, as_of: str, max_age_hours: int = 24) -> DataFrame:
    """Prices of the newest cached document younger than the limit; no rows without one."""
    entry = "map<string, struct<input_cost_per_token: double, output_cost_per_token: double, cache_read_input_token_cost: double, cache_creation_input_token_cost: double>>"
    docs = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(
        F.from_json("value", f"timestamp string, data {entry}").alias("d")
    ).select(F.try_to_timestamp("d.timestamp").alias("at"), F.col("d.data").alias("data"))
    limit = F.lit(as_of).cast("timestamp")
    fresh = docs.where((F.col("at") <= limit) & (F.col("at") > limit - F.expr(f"INTERVAL {max_age_hours} HOURS")))
    newest = fresh.agg(F.max_by("data", "at").alias("data"))
    return newest.select(F.explode("data").alias("model", "p")).select(
        "model", F.lit("list").alias("origin"), F.col("p.input_cost_per_token").alias("input"), F.col("p.output_cost_per_token").alias("output"),
        F.col("p.cache_read_input_token_cost").alias("cache_read"), F.col("p.cache_creation_input_token_cost").alias("cache_creation"),
    )


def read_text_like(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Documents by their kind: whole texts (markup too), or rows of csv and json lines."""
    if extension in ("txt", "md", "html", "json", "xml"):
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    if extension == "jsonl":
        return numbered_lines(spark, path)
    if extension == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    raise ValueError(f"unsupported extension: {extension}")


def read_xml_rows(spark: SparkSession, path: str, element: str, fields: str) -> DataFrame:
    """Rows of the elements named ``element``; files are split, so none is one task."""
    return spark.read.format("xml").option("rowTag", element).schema(fields).load(path)


def recent_lines(lines: DataFrame, n: int = 4000) -> DataFrame:
    """The last ``n`` lines, in order (a sort with a limit: every task sends at most ``n`` rows)."""
    return lines.orderBy(F.col("file_rank").desc(), F.col("line_number").desc()).limit(n)

