"""Exact dedup: a minimal perfect hash over the distinct digests of the history, byte-checked by every later digest.

Texts are equal when they are the same after deleting white space (space, tab to carriage return).  Rows are combined to one row per
distinct digest before anything is shuffled by digest, so a group of copies of any size costs one row per map task.  The distinct
digests of the history are dealt over shards by their leading bytes; each shard holds a minimal perfect hash whose slots store the
whole digest and where the winner is.  Arriving distinct digests look up their slot and compare all 32 bytes: members merge with the
slot, the others form groups of their own.

Defined results: a null text counts as empty; a null id loses against any id; of rows that tie in length and id exactly one stays;
an empty table gives an empty result; other columns are never looked at and may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import mix64, place_of, positional, stored, text_or_empty

# Characters deleted before texts are compared (fixed values).
WHITE_SPACE = " \t\n\x0b\x0c\r"

SHARD_DIGESTS = 100_000  # distinct digests of one shard of the index, on average
SLOTS_PER_KEY = 2  # positions per remaining key in each level of the hash

GROUP_SCHEMA = "digest binary, n long, points long, has_id boolean, id long, rid long, in_history boolean"
INDEX_SCHEMA = "shard int, sizes array<int>, bits binary, digests binary, n binary, points binary, has_id binary, id binary, rid binary"


def digest_of(text: str | Column) -> Column:
    """SHA-256 of the text without white space, as bytes."""
    return F.unhex(F.sha2(F.translate(text_or_empty(text), WHITE_SPACE, ""), 256))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, digest, code points, and a row id that tells repeated rows apart."""
    return docs.select(
        F.col(id_col).alias("id"),
        digest_of(text_col).alias("digest"),
        F.length(text_or_empty(text_col)).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("rid"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: its rows, and the winner (most code points, smallest id, first row)."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "rid"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), best.alias("b")).select(
        "digest", "n", (-F.col("b.less")).alias("points"), (~F.col("b.no_id")).alias("has_id"), F.coalesce("b.id", F.lit(0)).cast("long").alias("id"), "b.rid"
    )


def _words(digests: list[bytes] | bytes) -> np.ndarray:
    joined = digests if isinstance(digests, bytes) else b"".join(digests)
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 4)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix64(words[:, 0] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
    for k in range(1, 4):
        h = mix64(h ^ words[:, k])
    return (h % np.uint64(size)).astype(np.int64)


def perfect_slots(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the bits of all levels, and the slot of each (distinct) key.

    A key that is alone at its position of a level sets that bit; the others go on to the next level.  The slot is the rank of the bit.
    """
    sizes: list[int] = []
    levels: list[np.ndarray] = []
    slots = np.empty(len(words), np.int64)
    left, taken = np.arange(len(words)), 0
    while len(left):
        size = SLOTS_PER_KEY * len(left)
        at = _positions(words[left], len(sizes), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = taken + np.cumsum(bits)[at[alone]] - 1
        taken += int(bits.sum())
        sizes.append(size)
        levels.append(bits)
        left = left[~alone]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), slots


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The only slot that can hold each key, or -1."""
    found = np.full(len(words), -1, np.int64)
    left, start, taken = np.arange(len(words)), 0, 0
    for level, size in enumerate(sizes):
        here = bits[start : start + size]
        at = _positions(words[left], level, size)
        hit = here[at]
        found[left[hit]] = taken + np.cumsum(here)[at[hit]] - 1
        start, taken, left = start + size, taken + int(here.sum()), left[~hit]
    return found


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(list(pdf["digest"]))
    sizes, bits, slots = perfect_slots(words)
    order = np.argsort(slots)
    column = lambda name, kind: pdf[name].to_numpy(kind)[order].tobytes()
    return pd.DataFrame([{
        "shard": pdf["shard"].iloc[0], "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": words[order].tobytes(),
        "n": column("n", "int64"), "points": column("points", "int64"), "has_id": column("has_id", "bool"),
        "id": column("id", "int64"), "rid": column("rid", "int64"),
    }])


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.crc32(F.substring("digest", 1, 8)), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash, and its slots with whole digests, group sizes and winners."""
    return _sharded(distinct_digests(history), shards).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def _merge(index: pd.DataFrame, arriving: pd.DataFrame) -> pd.DataFrame:
    parts = {"n": "int64", "points": "int64", "has_id": "bool", "id": "int64", "rid": "int64"}
    new = {k: arriving[k].to_numpy(kind) for k, kind in parts.items()}
    words = _words(list(arriving["digest"]))
    if len(index):
        row = index.iloc[0]
        old = {k: np.frombuffer(row[k], kind).copy() for k, kind in parts.items()}
        held = _words(row["digests"])
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        slot = slots_of(words, sizes, bits)
        member = slot >= 0
        member[member] = (held[slot[member]] == words[member]).all(axis=1)
        s, m = slot[member], member
        old["n"][s] += new["n"][m]
        # The arriving winner replaces the slot's if it is longer, then if its id is smaller, then if its row is earlier.
        ahead = np.zeros(m.sum(), bool)
        tied = np.ones(m.sum(), bool)
        for k, sign in (("points", 1), ("has_id", 1), ("id", -1), ("rid", -1)):
            a, b = sign * new[k][m].astype(np.int64), sign * old[k][s].astype(np.int64)
            ahead |= tied & (a > b)
            tied &= a == b
        for k in ("points", "has_id", "id", "rid"):
            old[k][s[ahead]] = new[k][m][ahead]
    else:
        old, held, member = {k: np.zeros(0, kind) for k, kind in parts.items()}, np.zeros((0, 4), np.uint64), np.zeros(len(words), bool)
    both = {k: np.concatenate([old[k], new[k][~member]]) for k in parts}
    digests = [w.tobytes() for w in held] + [w.tobytes() for w in words[~member]]
    return pd.DataFrame({"digest": digests, **both, "in_history": np.arange(len(digests)) < len(held)})


def look_up(index: DataFrame, arriving: DataFrame, shards: int) -> DataFrame:
    """All groups of history and arriving rows together: members merged with their slot, nonmembers on their own."""
    groups = _sharded(distinct_digests(arriving), shards)
    return index.groupBy("shard").cogroup(groups.groupBy("shard")).applyInPandas(_merge, GROUP_SCHEMA)


def groups_of(rows: DataFrame, is_history: Column) -> DataFrame:
    """Digest groups of a stored table of ``records``, the part that ``is_history`` names being indexed first."""
    shards = 1 + rows.count() // SHARD_DIGESTS
    index = stored(build_index(rows.filter(is_history), shards), "digest-index")
    return look_up(index, rows.filter(~is_history), shards)


def earlier_half(rows: DataFrame) -> Column:
    """Rows with an id up to the median came first; any split gives the same groups."""
    middle = rows.agg(F.percentile_approx("id", 0.5, 1000)).first()[0]
    return F.lit(False) if middle is None else F.coalesce(F.col("id") <= middle, F.lit(False))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, id of the row of its group that stays, rows of the group, whether this row stays, digest."""
    rows = stored(records(docs, id_col, text_col), "digests")
    groups = groups_of(rows, earlier_half(rows)).select(
        "digest", "n", F.when(F.col("has_id"), F.col("id")).alias("keep_id"), F.col("rid").alias("keep_rid"), "in_history"
    )
    return rows.join(groups, "digest").select(
        F.col("id"), "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest", "in_history"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    The winners are picked on narrow rows; texts move once, to meet the winner of their digest.
    """
    rows = stored(records(docs, id_col, text_col), "digests")
    winners = groups_of(rows, earlier_half(rows)).select("digest", F.col("points").alias("most"), F.when(F.col("has_id"), F.col("id")).alias("keep_id"))
    own_id, own_text = place_of(docs, id_col), place_of(docs, text_col)
    named = positional(docs).withColumn("digest", digest_of(own_text)).withColumn("length", F.length(text_or_empty(own_text)).cast("long"))
    matched = named.join(winners, "digest").filter((F.col("length") == F.col("most")) & F.col(own_id).eqNullSafe(F.col("keep_id")))
    return matched.dropDuplicates(["digest"]).select(*positional(docs).columns).toDF(*docs.columns)
