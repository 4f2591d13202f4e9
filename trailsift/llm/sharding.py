"""Sharding by sampled splitters: records in key order, cut into shards of nearly equal bytes.

The key of a record is (hash of its text, id), so equal texts lie side by side.  A size-weighted sample of keys, bounded by a parameter,
gives quantile boundaries of many fine ranges.  The bytes of each range are then counted exactly; a range that the sample misjudged,
or that repeated rows or a long text overfill, is subdivided by key: keys with more than the mean bytes get a range of their own, and more
splitters are drawn between them.  Only rows of one and the same key are dealt by their row id.  Running sums inside the ranges plus the exact start of each range place every record
at its byte offset of the whole, and equal steps of that offset are the shards.  Only narrow rows (key, size, id) are shuffled.

Defined results: a null text has 0 bytes and the checksum of the empty text; null ids sort first; repeated rows lie side by side;
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailsift.llm.common import stored, text_or_empty

SHARDS = 40
RANGES_PER_SHARD = 32
SAMPLE_KEYS = 20_000  # expected keys in the sample
ROW_BYTES = 16  # counted for each record besides its text
OVERFULL = 4  # times the mean bytes of a range
HASH_BITS, BUCKET_BITS = 60, 10
NO_ID = -(2**63)


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: id, size, checksum, and the key (60 bits of the text's hash, id)."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("second"),
        F.monotonically_increasing_id().alias("rid"),
    )


def splitters(rows: DataFrame, total: int, ranges: int, sample: int = SAMPLE_KEYS) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample; a record is drawn with a chance in proportion to its size."""
    step = total / sample
    draw = F.pmod(F.xxhash64("rid", F.lit("splitter")), F.lit(2**52)) / F.lit(float(2**52))
    drawn = rows.filter(draw < F.col("size") / F.lit(step)).select("hash", "second", F.greatest(F.col("size"), F.lit(step)).alias("weight"))
    keys = sorted(drawn.collect())
    weight, cuts = sum(k.weight for k in keys), []
    reached = 0.0
    for k in keys:
        reached += k.weight
        if reached >= (len(cuts) + 1) * weight / ranges:
            cuts.append((k.hash, k.second))
    return sorted(set(cuts))


def range_of(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Adds the number of the range: how many splitters lie before the key.

    Splitters are looked up by the leading bits of the hash, so each record is compared with the few that share them.
    """
    shift = HASH_BITS - BUCKET_BITS
    heads = [c[0] >> shift for c in cuts]
    lookup = []
    for bucket in range(2**BUCKET_BITS):
        first = bisect_right(heads, bucket - 1)
        lookup.append((bucket, first, cuts[first : bisect_right(heads, bucket)]))
    few = rows.sparkSession.createDataFrame(lookup, "bucket int, first int, cuts array<struct<hash: long, second: long>>")
    key = F.struct("hash", "second")
    keyed = rows.withColumn("bucket", F.shiftright("hash", shift).cast("int")).join(F.broadcast(few), "bucket")
    before = F.size(F.filter("cuts", lambda c: c < key))
    return keyed.withColumn("range", F.col("first") + before).drop("bucket", "first", "cuts")


def _before(key: tuple[int, int]) -> tuple[int, int]:
    return (key[0], key[1] - 1) if key[1] > NO_ID else (key[0] - 1, 2**63 - 1)


def subdivide(rows: DataFrame, cuts: list[tuple[int, int]], mean: float, step: float) -> tuple[DataFrame, dict[int, int]]:
    """(rows with their range; bytes of the overfull ranges, each of which holds one key).  ``step``: bytes for each key drawn."""
    heavy: set[tuple[int, int]] = set()
    for turn in count():
        ranged = range_of(rows, cuts)
        single = {k for k, c in enumerate(cuts) if c in heavy}
        full = {r.range: r.bytes for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect() if r.bytes > OVERFULL * mean}
        mixed = [(k,) for k in full if k not in single]
        if not mixed:
            return ranged, full
        inside = ranged.join(F.broadcast(rows.sparkSession.createDataFrame(mixed, "range int")), "range")
        # At most one key for each mean of the bytes, so a bounded number comes to the driver.
        keys = inside.groupBy("hash", "second").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > mean).select("hash", "second").collect()
        found = {tuple(k) for k in keys}
        draw = F.pmod(F.xxhash64("rid", F.lit(f"splitter-{turn}")), F.lit(2**52)) / F.lit(float(2**52))
        drawn = inside.filter(draw < F.col("size") / F.lit(step)).select("range", "hash", "second", F.greatest("size", F.lit(step)).alias("weight")).collect()
        more, reached, at = [], 0.0, None
        for r in sorted(drawn, key=lambda r: (r.hash, r.second)):
            reached = reached if r.range == at else 0.0
            at = r.range
            reached += 0 if (r.hash, r.second) in found else r.weight
            if reached >= mean:
                more.append((r.hash, r.second))
                reached = 0.0
        heavy |= found
        cuts = sorted({*cuts, *more, *found, *map(_before, found)})


def _offsets(counted: list, start: dict) -> list[tuple]:
    out, at, seen = [], 0, 0
    for r in sorted(counted, key=lambda r: (r.range, r.piece)):
        out.append((r.range, r.piece, at, seen))
        at, seen = at + r.bytes, seen + r.rows
    start.update(bytes=at, rows=seen)
    return out


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per record: id, size, checksum, shard, slot (its place in the shard, gapless from 0), and the range it fell into."""
    spark = docs.sparkSession
    rows = stored(records(docs, id_col, text_col), "shard-records")
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("range"))
    mean = total / (shards * RANGES_PER_SHARD)
    ranged, full = subdivide(rows, splitters(rows, total, shards * RANGES_PER_SHARD), mean, total / SAMPLE_KEYS)
    pieces = [(k, int(size // mean) + 1) for k, size in full.items()]
    divided = F.broadcast(spark.createDataFrame(pieces, "range int, pieces int"))
    pieced = ranged.join(divided, "range", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int"), F.lit(0)))
    pieced = stored(pieced.drop("pieces"), "shard-ranges") if pieces else pieced.drop("pieces")
    sums = pieced.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    whole: dict[str, int] = {}
    starts = F.broadcast(spark.createDataFrame(_offsets(sums, whole), "range int, piece int, byte_start long, row_start long"))
    inside = Window.partitionBy("range", "piece").orderBy("hash", "second", "rid")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centre: Column = F.col("byte_start") * 2 + F.sum("size").over(running) * 2 - F.col("size")
    placed = pieced.join(starts, ["range", "piece"]).select(
        "id", "size", "text_crc32", "range",
        F.call_function("div", centre * shards, F.lit(2 * whole["bytes"])).cast("int").alias("shard"),
        (F.col("row_start") + F.row_number().over(inside) - 1).alias("place"),
    )
    placed = stored(placed, "shard-places")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # one row per shard
    return placed.join(firsts, "shard").select("id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), "range")
