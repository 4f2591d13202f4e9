"""Near-dedup by order MinHash: several least shingles, kept in text order, then an alignment.

Texts are compared as sequences of five-word shingles, each labelled with its occurrence in the text.  A band takes the ``ORDER`` labels
with the least hashes and joins them in the order of the text, so two texts share a band if they agree on those shingles *and* on their
order.  Texts that share a band are candidates; candidates that hang together form a clump.

Bands miss pairs of short texts, which have few labels to choose from.  Texts of up to ``SHORT / SIMILARITY`` labels therefore have exact
keys as well: of n labels the n - 0.8 n + 3 with the least values, every three of them in text order.  The chain of a pair that reaches the
similarity leaves out at most n - 0.8 n labels of either text, so its three least labels are a key of both: no such pair is lost if both
texts have keys, hence none in which one text has at most ``SHORT`` labels.

A clump is compared in blocks of bounded size: a matrix product counts common labels, and pairs that may reach the similarity are
aligned.  The alignment is the longest chain of common labels that rises in both texts, within the band of shifts that the threshold
allows; the similarity is that chain over all labels of the two.  Blocks return a spanning forest of the links, never pairs.

Equal texts (but for case and white space) are one class with one sketch, so copies cost nothing further.

Defined results: a null text counts as empty, and texts without words are equal; a text of fewer than five words is one shingle;
ids are whole numbers (null ids come last); repeated rows are copies; a very long text is one row of one task, with a few numbers a word;
an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import mix64, pieces, place_of, positional, stored, text_or_empty
from trailsift.llm.components import components
from trailsift.llm.rolling import running, stretches

WORDS = 5  # of a shingle
SIMILARITY = 0.8
ORDER = 8  # labels of a band
BANDS = 64
SHORT = 24  # labels of a text that meets every partner by exact keys
TOGETHER = 3  # labels of an exact key
BLOCK_LABELS = 300_000  # labels of a block, on average
LEAST_LABELS = 100  # that a text counts for in a block, so that its texts are bounded too
COLUMNS = 4096  # labels of one matrix product


def plain(text: str | Column) -> Column:
    """Lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(text), r"[\x09-\x0D\x20]+", " ")))


def labels_of(text: str) -> np.ndarray:
    """The occurrence-labelled shingles of a plain text, in order; all different."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode(), np.uint8)
    gaps = np.flatnonzero(points == 32)
    words = stretches(running(points), np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(points)]]))
    size = min(WORDS, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x100000001B3) + words[k : len(words) - size + 1 + k]
    shingles = mix64(rolled)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return shingles
    times = np.arange(len(ranked)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.empty(len(ranked), np.uint64)
    again[order] = times
    return np.where(again > 0, mix64(shingles + again * np.uint64(0x9E3779B97F4A7C15)), shingles)


_FACTORS = mix64(np.arange(1, BANDS + 1)) | np.uint64(1)
_SEQUENCE = mix64(np.arange(1000, 1000 + ORDER)) | np.uint64(1)


@cache
def _subsets(head: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(head), size)))


def exact_keys(labels: np.ndarray) -> np.ndarray:
    """Keys of a short text: it shares one with every short text that reaches the similarity."""
    size = min(TOGETHER, len(labels))
    head = len(labels) - int(np.ceil(SIMILARITY * len(labels) - 1e-9)) + size
    least = labels[np.sort(np.argsort(labels)[:head])]
    return mix64((least[_subsets(head, size)] * _SEQUENCE[None, :size]).sum(1, dtype=np.uint64)).view(np.int64)


def bands_of(labels: np.ndarray) -> np.ndarray:
    """One key per band: the least labels under the band's hash, in text order.  Short texts have exact keys, too."""
    if not len(labels):
        return np.zeros(0, np.int64)
    exact = exact_keys(labels) if len(labels) * SIMILARITY <= SHORT + 1e-9 else np.zeros(0, np.int64)
    if len(labels) <= ORDER:
        return exact  # all bands would hold the same labels
    size = ORDER
    step = max(1, 2_000_000 // len(labels))
    keys = []
    for k in range(0, BANDS, step):
        hashed = labels[None, :] * _FACTORS[k : k + step, None]
        least = np.sort(np.argpartition(hashed, size - 1, axis=1)[:, :size], axis=1)
        keys.append(mix64((labels[least] * _SEQUENCE[None, :size]).sum(1, dtype=np.uint64) + _FACTORS[k : k + step]))
    return np.concatenate([np.concatenate(keys).view(np.int64), exact])


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Do the texts reach the similarity when their common labels must keep their order?"""
    total = len(a) + len(b)
    shift = total - 2 * least / (1 + least) * total  # more labels than these can't be unmatched, so no match is further off the diagonal
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= shift
    rising = j[near][np.argsort(i[near])]
    if len(rising) < least / (1 + least) * total - 1e-9:
        return False
    if (np.diff(rising) > 0).all():
        chain = len(rising)
    else:
        tails: list[int] = []
        for x in rising.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        chain = len(tails)
    return chain >= least * (total - chain) - 1e-9


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, key of its class, number of labels, band keys."""
    asked = docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch["text"].to_pylist()
            labels = [labels_of(t) for t in texts]
            keys = pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary())
            sizes = pa.array([len(x) for x in labels], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], keys, sizes, pa.array([bands_of(x) for x in labels], pa.list_(pa.int64()))], ["id", "key", "labels", "bands"])

    return asked.mapInArrow(sketch, "id long, key binary, labels long, bands array<long>")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per class of equal texts, numbered: node, key, least id, documents, labels, bands."""
    lowest = F.min(F.struct(F.col("id").isNull(), "id"))["id"]
    grouped = rows.groupBy("key").agg(lowest.alias("least_id"), F.count("*").alias("n"), F.first("labels").alias("labels"), F.first("bands").alias("bands"))
    return grouped.withColumn("node", F.monotonically_increasing_id())


def clumps_of(classes: DataFrame) -> DataFrame:
    """Nodes that share a band, directly or through others: node, clump."""
    entries = classes.select("node", F.explode("bands").alias("band"))
    centres = entries.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("band", "centre")
    roots = components(entries.join(centres, "band").filter(F.col("node") != F.col("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")))
    return roots.select("node", F.col("root").alias("clump")).union(roots.select(F.col("root").alias("node"), F.col("root").alias("clump")).distinct())


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many labels each of ``x`` has in common with each of ``y``."""
    pool_x, pool_y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(pool_x, pool_y)
    out = np.zeros((len(x), len(y)), np.float32)
    places = []
    for pool, own in ((pool_x, x), (pool_y, y)):
        row = np.repeat(np.arange(len(own)), [len(a) for a in own])
        at = np.minimum(np.searchsorted(shared, pool), max(len(shared) - 1, 0))
        held = shared[at] == pool if len(shared) else np.zeros(len(pool), bool)
        places.append((row[held], at[held]))
    for k in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - k)
        sides = []
        for own, (row, at) in zip((x, y), places, strict=True):
            here = (at >= k) & (at < k + width)
            side = np.zeros((len(own), width), np.float32)
            side[row[here], at[here] - k] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _compare(least: float):  # noqa: ANN202
    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, left, right = key
        pdf = pdf.drop_duplicates("node")
        nodes = pdf["node"].to_numpy()
        labels = [labels_of(t) for t in pdf["text"]]
        block = pdf["block"].to_numpy()
        x = np.flatnonzero(block == left)
        y = x if left == right else np.flatnonzero(block == right)
        if not len(x) or not len(y):
            return pd.DataFrame({"node": [], "root": []})
        common = _common([labels[k] for k in x], [labels[k] for k in y])
        sizes = np.array([len(a) for a in labels])
        alike = common / np.maximum(sizes[x][:, None] + sizes[y][None, :] - common, 1)
        i, j = np.nonzero((alike >= least - 1e-6) & (x[:, None] != y[None, :]))
        order = np.argsort(-alike[i, j], kind="stable")
        root = np.arange(len(nodes))
        # Pairs already joined through others need no alignment: only the components count.
        for p, q in zip(x[i[order]].tolist(), y[j[order]].tolist(), strict=True):
            if root[p] != root[q] and aligned(labels[p], labels[q], least):
                low, high = min(root[p], root[q]), max(root[p], root[q])
                root[root == high] = low
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"node": nodes[linked], "root": nodes[root[linked]]})

    return compare


def links(docs: DataFrame, classes: DataFrame, clumps: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """A spanning forest of the links inside each clump: node, root."""
    spark = docs.sparkSession
    sized = stored(clumps.join(classes.select("node", "key", "least_id", "labels"), "node"), "clump-nodes")
    blocks = sized.groupBy("clump").agg(F.ceil(F.sum(F.greatest("labels", F.lit(LEAST_LABELS))) / F.lit(BLOCK_LABELS)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "clump").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    named = docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    # A merge at every size: what is moved then grows as the input does.
    wanted = placed.select("key", "least_id", "node", "clump", "block", "blocks").hint("merge")
    texts = named.join(wanted, "key").filter(F.col("id").eqNullSafe(F.col("least_id")))
    # Each block meets itself and every other one of its clump once.
    others = F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1))
    met = texts.select("clump", "node", "block", "text", others.alias("other"))
    met = met.select("clump", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "block", "text")
    return met.groupBy("clump", "left", "right").applyInPandas(_compare(least), "node long, root long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows of id and class key; per class key: least id, documents, root of its group)."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    classes = stored(classes_of(rows), "text-classes")
    clumps = stored(clumps_of(classes), "clumps")
    roots = components(links(docs, classes, clumps, least, id_col, text_col).select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = classes.select("node", "key", "least_id", "n").join(roots, "node", "left").select("key", "least_id", "n", F.coalesce("root", "node").alias("root"))
    return rows.select("id", "key"), stored(grouped, "text-groups")


def _heads(grouped: DataFrame) -> DataFrame:
    """Per group: the class and id that stays (least id, nulls last) and its number of documents."""
    first = F.min(F.struct(F.col("least_id").isNull(), "least_id", "key"))
    return grouped.groupBy("root").agg(first.alias("f"), F.sum("n").alias("group_size")).select("root", F.col("f.least_id").alias("keep_id"), F.col("f.key").alias("keep_key"), "group_size")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row: id, id of the document of its group that stays, documents of the group."""
    rows, grouped = groups(docs, id_col, text_col, least)
    of_key = grouped.join(_heads(grouped), "root").select("key", "keep_id", "group_size")
    return rows.join(of_key, "key").select("id", "keep_id", "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns."""
    _, grouped = groups(docs, id_col, text_col, least)
    heads = _heads(grouped).select(F.col("keep_key").alias("key"), "keep_id")
    named = positional(docs).withColumn("key", F.unhex(F.md5(plain(place_of(docs, text_col)))))
    matched = named.join(heads, "key").filter(F.col(place_of(docs, id_col)).cast("long").eqNullSafe(F.col("keep_id")))
    return matched.dropDuplicates(["key"]).select(*positional(docs).columns).toDF(*docs.columns)
