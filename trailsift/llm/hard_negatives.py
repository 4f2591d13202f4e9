"""Hard-negative mining by Fagin's threshold algorithm, exactly.

Rows are vectors of whole numbers with a label.  An anchor's positives are its best rows of the same label; its hard negatives are, for
each positive, the best rows of other labels whose score lies in a window below the positive's score.

Rows are dealt into blocks by a hash, so neither a hot label nor a group of copies makes a block larger.  A block keeps one list of its
rows for each dimension, sorted by that component.  An anchor reads each list from the end that its own sign favours, scores every row
that it meets for the first time over all components (the random access), and after each depth sums the components last read into a
threshold: no row not yet met scores higher.  A window is done once the threshold falls strictly below its k-th best score (strictly,
because ties go to the smaller id) or below the window itself.  Anchors are dealt in groups, every group meets every block, and a block
returns k rows for each window at most; the best k of these, by a window function, are the result.  The anchors are a stated query set
against all rows: nothing is left out, whatever the number of blocks.

Scores are exact: sums stay below 2**53 in double precision, or else are Python integers.

Defined results: rows without label, without vector, or with a null or non-finite component take no part; an anchor meets rows of its
own number of components only; rows with equal ids are separate rows, each an anchor of its own; a row without id is no anchor and comes
after all ids among equals; a score that no long holds counts as the nearest long; a positive score below zero has an empty window; an
empty vector scores 0; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailsift.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
BLOCK_ROWS = 2_048
GROUP_ANCHORS = 2_048
DEPTH = 8  # of the first sorted access; doubled each time

LONG = 2**63 - 1
FOUND = "anchor long, turn int, other long, other_id long, idless boolean, score long"


def usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite, F.lit(False))


def whole_numbers(vectors: pd.Series | list) -> np.ndarray:
    """floor(SCALE * x) of each component, a row for each vector; doubles where every score of such rows is exact, else Python integers."""
    plain = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(over="ignore"):
        scaled = np.floor(plain * SCALE)
    if plain.shape[1] * float(np.abs(scaled).max(initial=0)) ** 2 < 2**53:
        return scaled
    return np.array([[int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in row] for row in plain.tolist()], object)


class Lists:
    """Rows of one block with a list for each dimension, sorted by its component."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable") if rows.size else np.zeros(rows.shape, np.int64)

    def accesses(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """Sorted accesses: the rows met for the first time, their scores, and the most that a row not yet met can score."""
        n = len(self.rows)
        favoured = np.flatnonzero(anchor != 0)
        if not len(favoured):
            yield np.arange(n), self.rows @ anchor if anchor.size else np.zeros(n), -math.inf
            return
        rising = anchor[favoured] < 0
        met = np.zeros(n, bool)
        depth, step = 0, DEPTH
        while depth < n:
            upto = min(n, depth + step)
            front = self.order[depth:upto, favoured[rising]]
            back = self.order[n - upto : n - depth, favoured[~rising]]
            read = np.zeros(n, bool)
            read[front.ravel()] = read[back.ravel()] = True
            fresh = np.flatnonzero(read & ~met)
            met |= read
            if met.all():  # long before the lists end: no row is left for a threshold
                yield fresh, self.rows[fresh] @ anchor, -math.inf
                return
            last = np.where(rising, self.order[upto - 1, favoured], self.order[n - upto, favoured])
            threshold = (anchor[favoured] * self.rows[last, favoured]).sum() if upto < n else -math.inf
            yield fresh, self.rows[fresh] @ anchor, threshold
            depth, step = upto, step * 2

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most): the k best allowed rows in it and their scores; ties by id, its rank in ``ids``."""
        at, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        waiting = set(range(len(windows)))
        for fresh, score, threshold in self.accesses(anchor):
            part = allowed[fresh]
            at, scores = np.concatenate([at, fresh[part]]), np.concatenate([scores, np.clip(score[part], -LONG - 1, LONG) if scores.dtype == object else score[part]])
            for w in list(waiting):
                least, most = windows[w]
                inside = scores[(scores >= least) & (scores <= most)]
                if threshold < least or (len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]):
                    waiting.remove(w)
            if not waiting:
                break
        found = []
        for least, most in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            first = inside[np.lexsort((ids[at[inside]], -scores[inside]))[:k]]
            found.append((at[first], scores[first]))
        return found


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, k: int, same_label: bool, percent: int) -> DataFrame:
    """The k best of each block for each window of each anchor (``rid``, ``label``, ``vector``, ``scores``: a window for each)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    left = rows.select(F.size("vector").alias("width"), own(blocks).alias("block"), every(groups).alias("crowd"), "rid", "id", "idless", "label", "vector")
    # Both sides come from the same rows, so one of them gets columns of its own.
    right = anchors.select(F.size("vector").alias("width"), every(blocks).alias("block"), own(groups).alias("crowd"), *(F.col(c).alias(c) for c in ("rid", "label", "vector", "scores")))

    def meet(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(asked):
            numbers = whole_numbers([*block["vector"], *asked["vector"]])
            members, queries = numbers[: len(block)], numbers[len(block) :]
            labels, rid, ids, idless = (block[c].to_numpy() for c in ("label", "rid", "id", "idless"))
            rank = np.empty(len(block), np.int64)
            rank[np.lexsort((rid, ids, idless))] = np.arange(len(block))
            lists = {label: np.flatnonzero(labels == label) for label in np.unique(labels)} if same_label else {None: np.arange(len(block))}
            sorted_lists = {label: Lists(members[places]) for label, places in lists.items()}
            for query, own_rid, label, scores in zip(queries, asked["rid"], asked["label"], asked["scores"], strict=True):
                kind = label if same_label else None
                if kind not in lists:
                    continue
                places = lists[kind]
                allowed = rid[places] != own_rid if same_label else labels[places] != label
                # percent * positive <= 100 * negative <= 100 * positive, in whole numbers
                windows = [(-math.inf, math.inf)] if same_label else [(-(-percent * int(s) // 100), int(s)) for s in scores]
                for turn, (at, score) in enumerate(sorted_lists[kind].best(query, allowed, windows, k, rank[places])):
                    found += [(own_rid, turn, rid[p], ids[p], idless[p], int(s)) for p, s in zip(places[at], score, strict=True)]
        return pd.DataFrame(found, columns=["anchor", "turn", "other", "other_id", "idless", "score"])

    keys = ("width", "block", "crowd")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), "idless", "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive its hard negatives.

    ``is_anchor`` and ``label`` are expressions over the given columns.
    """
    vector, whole_id = F.col(vector_col).cast("array<double>"), F.col(id_col).cast("long")
    rows = vectors.filter(usable(label, vector)).select(
        F.coalesce(whole_id, F.lit(LONG)).alias("id"), whole_id.isNull().alias("idless"), label.cast("string").alias("label"), vector.alias("vector"),
        F.coalesce(is_anchor & whole_id.isNotNull(), F.lit(False)).alias("is_anchor"),
    )
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "labelled-vectors")
    totals = rows.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors")).first()
    blocks, groups = 1 + totals["rows"] // BLOCK_ROWS, 1 + totals["anchors"] // GROUP_ANCHORS
    asked = rows.filter("is_anchor").select("rid", "label", "vector", F.array().cast("array<long>").alias("scores"))
    best = stored(_first(_searched(rows, asked, blocks, groups, positives, True, percent), positives), "positives")
    # One array entry for each positive; its place is the turn of its window.
    scores = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    windows = rows.select("rid", "label", "vector").join(scores.withColumnRenamed("anchor", "rid"), "rid")
    hard = _first(_searched(rows, windows, blocks, groups, negatives, False, percent), negatives)
    named = lambda id_, idless: F.when(~F.col(idless), F.col(id_))
    pairs = best.select("anchor", (F.col("rank") - 1).alias("turn"), named("other_id", "idless").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = rows.filter("is_anchor").select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.join(pairs, ["anchor", "turn"]).join(anchors, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), named("other_id", "idless").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
