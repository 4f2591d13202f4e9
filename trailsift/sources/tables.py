"""Parquet tables that are replaced by version, and the ledger of import runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from trailsift.operators.catalog import upsert_by_key
from trailsift.session import scratch_path


def case_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder for a query that writes and reads back."""
    return scratch_path(spark, label)


def foldered(df: DataFrame, column: str, order: str | None = None) -> DataFrameWriter:
    """A writer of a folder for each value of ``column``, however many, into a path that nobody reads before the job is done.

    ``order`` orders the rows of a folder and is not written.  The number of files tells the work, not their bytes, so all cores write;
    and tasks put their own files in place, where by default the driver would move them all, one after another.
    """
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, column)
    if order:
        dealt = dealt.sortWithinPartitions(column, order).drop(order)
    return dealt.write.partitionBy(column).option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one of the same shape where none was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class VersionedTable:
    """A table whose every change is a new folder.

    Parquet has no MERGE, and a job must not overwrite the files it reads.  A change writes the next
    version whole; rows that are only added are a *part* beside the version they belong to.  Spark's
    ``_SUCCESS`` mark is the commit; readers take the highest version that has one, with its marked
    parts.  A lost job leaves an unmarked folder that nobody reads, and a part that is written again
    under its name replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _marked(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        folders = [status.getPath() for status in fs.listStatus(root)]
        return sorted(f.getName() for f in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def versions(self) -> list[int]:
        return [int(name[1:]) for name in self._marked() if name[0] == "v" and name[1:].isdigit()]

    def append(self, rows: DataFrame, part: str) -> None:
        """Add rows to the current version; nothing that is there is written again."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self.versions()[-1]:08d}+{part}")

    def publish(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        version = (self.versions() or [0])[-1] + 1
        writer = rows.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/v{version:08d}")
        return version

    def read(self, without_part: str | None = None) -> DataFrame:
        current = f"v{self.versions()[-1]:08d}"
        left_out = f"{current}+{without_part}"
        folders = [n for n in self._marked() if n == current or (n.startswith(current + "+") and n != left_out)]
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in folders])

    def compact(self) -> int:
        """Write version and parts as one new version."""
        return self.publish(self.read())

    def upsert(self, source: DataFrame, key: str, order: str) -> int:
        return self.publish(upsert_by_key(self.read(), source, key, order))


LEDGER = (
    "id string, started_at string, completed_at string, source_records string, source_images string, status string, "
    "total_records bigint, imported_count bigint, skipped_count bigint, error_count bigint, orphan_count bigint"
)


class RunLedger:
    """Append-only rows per run; the latest row of a run is its state."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def start(self, run: str, records: str, images: str, started_at: str) -> None:
        row = [(run, started_at, None, records, images, "running", 0, 0, 0, 0, 0)]
        self.spark.createDataFrame(row, LEDGER).write.mode("append").parquet(self.path)

    def finish(self, run: str, stats: DataFrame, completed_at: str) -> None:
        begun = read_or_empty(self.spark, self.path, LEDGER).where((F.col("id") == run) & (F.col("status") == "running"))
        row = begun.select("id", "started_at", "source_records", "source_images").limit(1).join(stats)  # one row each
        columns = [c.split()[0] for c in LEDGER.split(", ")]
        done = row.withColumn("completed_at", F.lit(completed_at)).select(*columns)
        done.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        rows = read_or_empty(self.spark, self.path, LEDGER)
        others = [c for c in rows.columns if c != "id"]
        return rows.groupBy("id").agg(F.max_by(F.struct(*others), F.coalesce("completed_at", F.lit(""))).alias("r")).select("id", "r.*")
