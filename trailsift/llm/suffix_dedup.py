"""Removal of byte strings that occur twice: sampled anchors, then a bounded search for common prefixes on a Burrows-Wheeler transform.

Every 200-byte window has an anchor, the 64-byte string in it with the least hash; equal windows have equal anchors at equal places.
Neighbouring windows with the same anchor form a context, a stretch of at most 336 bytes.  Spark counts anchors and contexts:

* an anchor that occurs once: none of its windows occurs elsewhere;
* a context that occurs more than once: all of its windows do;
* different contexts of one anchor: their bytes are compared.

For that, contexts are dealt by anchor to blocks of bounded size.  A block sorts its suffixes, and a breadth-first search extends intervals
of the transform backwards, 20 bytes a level.  Each level finds the neighbours of the suffix order whose common prefix ends within it;
after 200 bytes, ten levels, the neighbours not yet found share a window.  An anchor with more than ``CONTEXTS`` different contexts, as at the
edge of a passage that very many documents share, would overfill a block: its windows are counted by their hash, in Spark.

Texts move once to meet their anchors; after that only texts with undecided contexts do.

Defined results: a null text counts as empty; a text of fewer than 200 bytes is kept whole; copies and repeated rows remove each other's
windows; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import pieces, stored, text_or_empty
from trailsift.llm.rolling import running, stretches

WINDOW = 200  # bytes
ANCHOR = 64  # bytes; shorter ones are repeated by chance more often, longer ones are more in number
REACH = WINDOW - ANCHOR + 1  # anchors of a window
CONTEXTS = 1_000  # different contexts of an anchor that a block takes
BLOCK_BYTES = 750_000  # of contexts, on average
STEP = 20  # bytes by which the search extends a common prefix at a level

ANCHOR_SCHEMA = "row binary, hashes array<long>, contexts array<long>, starts array<int>, sizes array<int>"
CUT_SCHEMA = "hash long, context long, several long, rid long, start int, size int, bytes binary"
FOUND_SCHEMA = "rid long, start int, size int"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: running minima from both ends of blocks of that width."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors_of(data: bytes) -> tuple[np.ndarray, ...]:
    """Per context, in order: hash of its anchor, hash of the context, first window, number of windows."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    sums = running(np.frombuffer(data, np.uint8))
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = stretches(sums, at, at + ANCHOR)
    # The place in the low half makes the leftmost of equal hashes the least.
    least = _sliding_least((hashes & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64), REACH)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    contexts = stretches(sums, starts, starts + sizes + WINDOW - 1)
    return hashes[anchor[starts]].view(np.int64), contexts.view(np.int64), starts.astype(np.int32), sizes.astype(np.int32)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [anchors_of(t.encode()) for t in batch["text"].to_pylist()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch["row"], *columns], ["row", "hashes", "contexts", "starts", "sizes"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), text_or_empty(text_col))))
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), row.alias("row"))


def repeated_contexts(anchors: DataFrame) -> DataFrame:
    """Contexts whose anchor occurs more than once: rid, hash, context, start, size; ``whole`` (the context occurs again), ``several``
    (different contexts of the anchor) and ``first`` (this one stands for all equal ones)."""
    zipped = F.explode(F.arrays_zip("hashes", "contexts", "starts", "sizes")).alias("z")
    every = anchors.select("rid", zipped).select("rid", F.col("z.hashes").alias("hash"), F.col("z.contexts").alias("context"), F.col("z.starts").alias("start"), F.col("z.sizes").alias("size"))
    again = every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    repeated = stored(every.join(again, "hash"), "repeated-anchors")
    contexts = repeated.groupBy("hash", "context").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("first"))
    contexts = stored(contexts, "context-counts")
    several = contexts.groupBy("hash").agg(F.count("*").alias("several"))
    judged = stored(contexts.join(several, "hash"), "contexts-judged")
    own = F.struct("rid", "start")
    return repeated.join(judged, ["hash", "context"]).select(
        "rid", "hash", "context", "start", "size", (F.col("n") > 1).alias("whole"), "several", (F.col("first") == own).alias("first")
    )


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes of overlapping or touching stretches."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _rest(data: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """Bytes, bytes removed, runs removed, digest of what is left."""
    kept, at = hashlib.sha256(), 0
    for a, b in runs:
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()


def _runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    starts = np.array([s["start"] for s in spans or ()], np.int64)
    sizes = np.array([s["size"] for s in spans or ()], np.int64)
    return covered(starts, starts + sizes + WINDOW - 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts that are to be compared; those known to be repeated take part without a row of their own."""
    names = [name.split()[0] for name in CUT_SCHEMA.split(", ")]
    for batch in pieces(batches):
        rows: list[tuple] = []
        for rid, text, spans in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), batch["open"].to_pylist(), strict=True):
            data = text.encode()
            for s in spans:
                rows.append((s["hash"], s["context"], s["several"], None if s["whole"] else rid, s["start"], s["size"], data[s["start"] : s["start"] + s["size"] + WINDOW - 1]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def _ranks_in(values: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``values`` (less than ``2**bits``) in ascending order; value and place are sorted as one number where they fit in it."""
    width = len(values).bit_length()
    if bits + width > 63:
        return np.argsort(values, kind="stable")
    packed = (values << width) | np.arange(len(values))
    packed.sort()
    return packed & ((1 << width) - 1)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order, by doubling the length they are compared on; ``symbols`` tells all suffixes apart within ``depth``.

    A suffix that stands alone in its class has its place and is not sorted again.
    """
    n, width = len(symbols), int(symbols.max()) + 2
    # As many symbols as fit in 62 bits make the first key.
    length = max(1, int(62 / np.log2(width)))
    key = np.zeros(n, np.int64)
    for k in range(length):
        key *= width
        key[: max(n - k, 0)] += symbols[k:] + 1
    order = np.argsort(key)
    key = key[order]
    tied = np.arange(n)  # places not settled yet
    rank = np.empty(n, np.int64)
    at = order.copy()
    bits = n.bit_length()
    while True:
        edge = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=edge[1:-1])
        first = np.flatnonzero(edge[:-1])
        heads = np.repeat(tied[first], np.diff(first, append=len(at)))
        rank[at] = heads
        more = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(more) or length >= depth:
            return order
        tied, heads, at = tied[more], heads[more], at[more]
        ahead = at + length
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        if 3 * bits <= 63:
            key |= heads << bits
            key <<= bits
            key |= at
            key.sort()
            at = key & ((1 << bits) - 1)
            key >>= bits
        else:
            by = np.lexsort((key, heads))
            at, key = at[by], ((heads << bits) | key)[by]
        order[tied] = at
        length *= 2


def _grams(symbols: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For each place of the suffix order: the number of its class by the first ``size`` symbols."""
    n, width = len(order), int(symbols.max()) + 1
    packed_size = min(size, max(1, int(62 / np.log2(width))))
    packed = np.zeros(n, np.int64)
    for k in range(packed_size):
        packed *= width
        packed += np.roll(symbols, -k)
    edge = np.ones(n, bool)
    edge[1:] = False
    for k in range(0, size, packed_size):
        own = packed[(order + min(k, size - packed_size)) % n]
        edge[1:] |= own[1:] != own[:-1]
    return np.cumsum(edge)


def long_neighbours(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix order: is the common prefix with the place before it ``least`` symbols or longer?

    Level by level, intervals of suffixes with a common prefix are extended by the ``STEP`` symbols before them (by one, for what is left
    of ``least``).  The first interval that ends just before a place shows that the common prefix there ends within the level; intervals
    that show nothing new are dropped.
    """
    n = len(order)
    bits = n.bit_length()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    unknown = np.ones(n + 1, bool)
    unknown[0] = unknown[n] = False
    low, high = np.array([0]), np.array([n - 1])
    step = 0
    for size in [STEP] * (least // STEP) + [1] * (least % STEP):
        if step != size:
            step = size
            # Where the suffix that begins ``step`` symbols earlier stands, and what these symbols are.
            back, grams = place[(order - step) % n], _grams(symbols, order, step)
        sizes = high - low + 1
        owner = np.repeat(np.arange(len(low)), sizes)
        places = np.arange(len(owner)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        longer = back[places]
        by = _ranks_in(longer, bits)
        longer, owner = longer[by], owner[by]
        gram = grams[longer]
        last = np.ones(len(owner), bool)
        last[:-1] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        first = np.concatenate([[True], last[:-1]])
        low, high = longer[first], longer[last]
        new = unknown[high + 1]
        unknown[high[new] + 1] = False
        low, high = low[new], high[new]
        if not len(low):
            break
    return unknown[:n]


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of the block's contexts that occur in another context: rid, start, size."""
    parts = pdf["bytes"].tolist()
    lengths = np.array([len(p) for p in parts]) + 1
    starts = np.cumsum(lengths) - lengths
    symbols = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int64)
    # Each context ends in a symbol of its own, so no common prefix runs over an end.
    symbols[starts + lengths - 1] = 256 + np.arange(len(parts))
    order = suffix_order(symbols, 512)
    shared = long_neighbours(symbols, order, WINDOW)
    either = shared | np.concatenate([shared[1:], [False]])
    hit = np.zeros(len(symbols), bool)
    hit[order[either]] = True
    out = []
    for at, rid, first, size in zip(starts, pdf["rid"], pdf["start"], pdf["size"], strict=True):
        if not pd.isna(rid) and hit[at : at + size].any():
            own = np.diff(np.concatenate([[0], hit[at : at + size].astype(np.int8), [0]]))
            out += [(int(rid), first + a, b - a) for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1), strict=True)]
    return pd.DataFrame(out, columns=["rid", "start", "size"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        hashes = []
        for data, size in zip(batch["bytes"].to_pylist(), batch["size"].to_pylist(), strict=True):
            at = np.arange(size)
            hashes.append(stretches(running(np.frombuffer(data, np.uint8)), at, at + WINDOW).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["hash"], batch["rid"], batch["start"], pa.array(hashes, pa.list_(pa.int64()))], ["hash", "rid", "start", "windows"])


def shared_windows(cut: DataFrame) -> DataFrame:
    """Windows that different contexts of an anchor have in common: rid, start, size."""
    cut = stored(cut, "contexts")
    fits = F.col("several") <= CONTEXTS
    total = cut.filter(fits).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    dealt = cut.filter(fits).withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks))).select("block", "rid", "start", "size", "bytes")
    searched = dealt.groupBy("block").applyInPandas(_search, FOUND_SCHEMA)
    # Contexts of few anchors lie together; windows are made where they have been dealt out evenly.
    spread = cut.filter(~fits).select("hash", "rid", "start", "size", "bytes").repartition("hash", "rid", "start")
    hashed = spread.mapInArrow(_window_hashes, "hash long, rid long, start int, windows array<long>")
    each = hashed.select("hash", "rid", "start", F.posexplode("windows").alias("k", "window"))
    again = each.groupBy("hash", "window").agg(F.count("*").alias("n")).filter("n > 1").select("hash", "window")
    counted = each.filter(F.col("rid").isNotNull()).join(again, ["hash", "window"]).select("rid", (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("size"))
    return searched.union(counted)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` of the bytes that stay."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    anchors = stored(keyed.select("row", "text").mapInArrow(_anchored, ANCHOR_SCHEMA).withColumn("rid", F.monotonically_increasing_id()), "anchors")
    spans = repeated_contexts(anchors)
    open_span = (~F.col("whole")) | (F.col("first") & (F.col("several") > 1))
    own = spans.groupBy("rid").agg(
        F.collect_list(F.when(F.col("whole"), F.struct("start", "size"))).alias("whole"),
        F.collect_list(F.when(open_span, F.struct("hash", "context", "several", "whole", "start", "size"))).alias("open"),
        F.bool_or(~F.col("whole")).alias("undecided"),
    )
    # Rows that repeat share key and text, and all of their contexts are repeated: one of them stands for all.
    named = own.join(anchors.select("rid", "row"), "rid").groupBy("row").agg(F.max_by(F.struct("rid", "whole", "open", "undecided"), F.struct(F.size("open"), "rid")).alias("o"))
    met = keyed.join(named.select("row", "o.*"), "row", "left")
    asked = met.select("id", "text", "rid", "whole", "open", F.coalesce("undecided", F.lit(False)).alias("undecided"))
    id_field = asked.schema["id"]
    result = T.StructType([id_field, *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    middle = T.StructType([*result.fields, *T.StructType.fromDDL("rid long, text string").fields, asked.schema["whole"], asked.schema["open"], *T.StructType.fromDDL("undecided boolean").fields])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rests = [_rest(t.encode(), _runs(w)) for t, w in zip(batch["text"].to_pylist(), batch["whole"].to_pylist(), strict=True)]
            numbers = [pa.array([r[k] for r in rests], pa.int64()) for k in range(3)]
            # Only texts that are needed again go on.
            needed = [bool(o) for o in batch["open"].to_pylist()]
            texts = pa.array([t if n else None for t, n in zip(batch["text"].to_pylist(), needed, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *numbers, pa.array([r[3] for r in rests], pa.string()), batch["rid"], texts, batch["whole"], batch["open"], batch["undecided"]], middle.names
            )

    decided = stored(asked.mapInArrow(decide, middle), "decided")
    cut = decided.filter(F.size("open") > 0).select("rid", "text", "open").mapInArrow(_cut, CUT_SCHEMA)
    found = shared_windows(cut).groupBy("rid").agg(F.collect_list(F.struct("start", "size")).alias("found"))
    late = decided.filter("undecided").select("id", "text", "rid", "whole").join(found, "rid", "left").select("id", "text", "whole", "found")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = (batch[k].to_pylist() for k in ("text", "whole", "found"))
            rests = [_rest(t.encode(), _runs([*(w or ()), *(f or ())])) for t, w, f in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array([r[k] for r in rests], pa.int64()) for k in range(3)), pa.array([r[3] for r in rests], pa.string())], result.names)

    return decided.filter(~F.col("undecided")).select(*result.names).union(late.mapInArrow(finish, result))
