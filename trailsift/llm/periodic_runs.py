"""Periodic runs of words: seeds of guaranteed overlap, extended along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4q) words that no neighbouring word extends.  A run
of period q shares max(6, 4q) - q words or more with itself moved on by q.  Periods are taken in classes Q, Q + 1, ...; k, the least
such overlap of a class, is the length of its seeds, and the class ends where k falls short of 2q - 1.  The first k words of a run recur
q words later and, by the theorem of Fine and Wilf, not sooner (k >= 2q - 1 and a smaller lag would give the run a smaller period).  So
it is enough to pair each occurrence of a k-gram in a document with the next one: n pairs a class at most, and no run is lost.

K-grams are named exactly, by pairs of names of half their length (prefix doubling); a document without repeats of that length is done
early.  A pair whose start lies before the furthest place covered on its lag belongs to an extension already made and is skipped, so
each diagonal is compared once.  A pair that is the next occurrence at lag q has smallest period q, by the same theorem.

The work of a text is n log n in its words and stays inside the text: one pass, no shuffle.

Defined results: a null, empty or blank text has no runs and an empty collapsed text; every row gets its own result, repeated rows too;
a very long text is one row of one task, with a few numbers a word; an empty table gives an empty result; other columns are never
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import pieces

LEAST_WORDS = 6
LEAST_TURNS = 4


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_TURNS * period)


def seed_classes(n: int) -> Iterator[tuple[int, int, int]]:
    """(first period, last period, seed length) of each class that fits into n words."""
    first = 1
    while least_length(first) <= n:
        seed = least_length(first) - first
        last = (seed + 1) // 2
        yield first, last, seed
        first = last + 1


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of names, as one number each."""
    return left * (right.max(initial=0) + 1) + right


def recurrences(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every name that occurs again: its place, ascending, and how far on the next occurrence is."""
    order = np.argsort(names, kind="stable")
    again = np.flatnonzero(names[order[1:]] == names[order[:-1]])
    at = order[again]
    lag = order[again + 1] - at
    ascending = np.argsort(at)
    return at[ascending], lag[ascending]


def _matches(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common prefix, found in steps that double."""
    done, step, size = 0, 16, min(len(left), len(right))
    while done < size:
        other = np.flatnonzero(left[done : done + step] != right[done : done + step][: size - done])
        if len(other):
            return done + int(other[0])
        done, step = done + step, step * 2
    return size


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the numbers of the words, by start and period."""
    n = len(words)
    found = []
    covered: dict[int, int] = {}
    names, size = words.astype(np.int64), 1
    for first, last, seed in seed_classes(n):
        while size * 2 <= seed:
            names = np.unique(_named(names[:-size], names[size:]), return_inverse=True)[1]
            size *= 2
        if len(names) and int(names.max()) + 1 == len(names):
            break  # no gram of this length recurs, so no longer one does
        at, lag = recurrences(_named(names[: n - seed + 1], names[seed - size :]))
        fits = (lag >= first) & (lag <= last)
        for i, q in zip(at[fits].tolist(), lag[fits].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            start = i - _matches(words[:i][::-1], words[: i + q][::-1])
            end = i + seed + _matches(words[i + seed : n - q], words[i + seed + q :]) + q
            covered[q] = end - q
            if end - start >= least_length(q):
                found.append((start, end - start, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep).tolist())


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id``, ``runs`` (by start, then period) and the text ``collapsed`` to one turn of each run."""
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([asked.schema["id"], T.StructField("runs", T.ArrayType(T.StructType(
        [T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])
    arrow_runs = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            runs, left = [], []
            for text in batch["text"].to_pylist():
                words = (text or b"").split()  # of bytes: at the space and at 09 to 0D, nowhere else
                number: dict[bytes, int] = {}
                found = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(collapsed(words, found).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(runs, arrow_runs), pa.array(left, pa.string())], schema.names)

    return asked.mapInArrow(run, schema)
