"""Licence scan, hard negatives and periodic runs against plain Python, and on odd rows."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import frame, odd_rows, words
from trailsift.llm import hard_negatives, license_scan, periodic_runs


def slow_runs(ws):
    found = []
    for q in range(1, len(ws) // 4 + 1):
        same = [ws[i] == ws[i + q] for i in range(len(ws) - q)]
        at = 0
        for equal, group in itertools.groupby(same):
            size = len(list(group))
            length = size + q
            stretch = ws[at : at + length]
            if equal and length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((at, length, q))
            at += size
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapse(ws, runs):
    return [w for i, w in enumerate(ws) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_all_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(1500):
        ws = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, 80))]
        if len(ws) > 8 and rng.random() < 0.6:
            a = rng.randrange(len(ws))
            p = rng.randint(1, max(1, (len(ws) - a) // 3))
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, len(ws))]
        runs = slow_runs(ws)
        assert periodic_runs.runs_of(np.array([ord(w) for w in ws], np.int64)) == runs
        coded = [w.encode() for w in ws]
        assert periodic_runs.collapsed(coded, runs) == b" ".join(slow_collapse(coded, runs))


def test_seed_classes_leave_no_period_out():
    last = 0
    for first, end, seed in periodic_runs.seed_classes(10_000):
        assert first == last + 1 and all(seed >= 2 * q - 1 and seed + q <= max(6, 4 * q) for q in (first, end))
        last = end
    assert last >= 2_500


def test_runs_of_odd_texts(spark):
    rows = [(1, "x " * 5, "en", "s"), (2, "x\n" * 6, "en", "s"), (3, "a b " * 7 + "tail", "en", "s"), (4, None, "en", "s"), (5, " \t", "en", "s"), (6, "a b c " * 4 + "a b", "en", "s")]
    rows += [(7, "p q r s t u v " * 5_000, "en", "s"), (2, "x\n" * 6, "en", "s"), (None, "y " * 9, None, None)]
    for clashing in (False, True):
        found = periodic_runs.find_runs(frame(spark, rows, clashing)).collect()
        assert len(found) == len(rows)
        by_id = {r.id: ([tuple(x) for x in r.runs], r.collapsed) for r in found}
        assert by_id[1] == ([], "x x x x x") and by_id[2] == ([(0, 6, 1)], "x") and by_id[3] == ([(0, 7, 1)], "a b tail")
        assert by_id[4] == by_id[5] == ([], "") and by_id[6] == ([(0, 14, 3)], "a b c") and by_id[None] == ([(0, 9, 1)], "y")
        assert by_id[7] == ([(0, 35_000, 7)], "p q r s t u v")
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0
    assert periodic_runs.find_runs(frame(spark, odd_rows(), True)).count() == len(odd_rows())


def slow_mine(rows, k=5, percent=80):
    """rows: (row, id, label, whole numbers)"""
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=True))
    order = lambda a: lambda b: (-score(a, b), b[1] is None, b[1] or 0, b[0])
    found = []
    for a in rows:
        if a[1] is None or a[1] % 100:
            continue
        others = [b for b in rows if b[0] != a[0] and len(b[3]) == len(a[3])]
        for p in sorted((b for b in others if b[2] == a[2]), key=order(a))[:k]:
            top = score(a, p)
            fits = [b for b in others if b[2] != a[2] and percent * top <= 100 * score(a, b) <= 100 * top]
            found += [(a[1], p[1], n, b[1], top, score(a, b)) for n, b in enumerate(sorted(fits, key=order(a))[:k], 1)]
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [7, 5_000])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "DEPTH", 1)
    rows = []
    for k in range(160):
        vector = [rng.choice([0.0, 0.25, 0.5, -0.125, rng.uniform(-1, 1)]) for _ in range(5)]
        rows.append((k * 20, vector if k % 9 else [0.5] * 5, rng.randrange(3) if k % 5 else 0))  # a hot label, many ties
    rows += [(100, rows[5][1], 0), (100, rows[5][1], 0), (None, rows[7][1], 1), (700, [0.0] * 5, 0), (800, [1.0, 2.0], 0), (820, [1.0, 1.5], 0), (840, [1.0, 1.25], 1), (900, [], 0)]
    unused = [(5, None, 0), (6, [1.0] * 5, None), (7, [float("nan")] * 5, 0), (8, [1.0, None, 0.0, 0.0, 0.0], 0), (9, [float("inf")] * 5, 1)]
    vectors = spark.createDataFrame(rows + unused, "vec_id long, embedding array<float>, label int").withColumn("rid", F.lit("clash")).withColumn("score", F.lit(0))
    found = hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, F.col("label"))
    kept = [(n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, label) in enumerate(rows)]
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow_mine(kept)
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(100, [2.0**40, 1.0], 0), (1, [2.0**10, 3.0], 0), (2, [2.0**10, 2.0], 1), (3, [2.0**10, 3.0], 1), (4, [1e30, 0.0], 1), (5, [2.0**9, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, F.col("label")).collect()
    top = 2**48 * 2**18 + 256 * 768
    held = min(top, 2**63 - 1)
    assert [(r.positive_id, r.positive_score) for r in found][:1] == [(1, held)] and {r.negative_id for r in found} >= {2, 3, 4}


def test_few_rows_are_met_where_one_is_far_ahead():
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(4_000, 4)) * 20)
    rows[17] = [900, 900, -900, 900]
    lists = hard_negatives.Lists(rows)
    met = list(itertools.takewhile(lambda part: part[2] >= 3_000, lists.accesses(np.array([1.0, 1.0, -1.0, 1.0]))))
    assert sum(len(part[0]) for part in met) < 400
    assert lists.best(np.array([1.0, 1.0, -1.0, 1.0]), np.ones(4_000, bool), [(-math.inf, math.inf)], 1, np.arange(4_000))[0][0].tolist() == [17]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_base_phrases_and_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "All rights reserved. ALL  RIGHTS\nRESERVED! cc by CC-BY", "en", "s"), (2, "Licensed under CC BY-NC 4.0.", "en", "s"), (3, "Licensed under the Apache License, Version 2.0.", "en", "s"),
        (4, "mit licence and an apache tribe", "en", "s"), (5, words(1, 50) + " " + mit + " " + words(2, 50), "en", "s"),
        (6, mit.replace("any person", "any kind or other person"), "en", "s"), (7, "generalé public license İcc by", "en", "s"), (8, None, "en", "s"), (9, "", "en", "s"),
        (10, ("license " * 3000 + "the mit licence ") * 30, "en", "s"), (1, "All rights reserved. ALL  RIGHTS\nRESERVED! cc by CC-BY", "en", "s"),
        (11, "This work is licensed under the GNU General Public License, version 3.", "en", "s"), (None, "MIT License", None, None), (12, "the mit license", "en", "s"),
    ]
    for clashing in (False, True):
        found = license_scan.scan(frame(spark, rows, clashing)).collect()
        assert len(found) == len(rows)
        by_id = {r.id: r for r in found}
        for i, text, *_ in rows:
            ws = WORD.findall(lowered(text or ""))
            phrases = [(p.split(), label) for p, label in license_scan.PHRASES]
            places = sorted((k, label) for p, label in phrases for k in range(len(ws)) if ws[k : k + len(p)] == p)
            assert (by_id[i].n_words, [tuple(p) for p in by_id[i].places]) == (len(ws), places), i
        labels = {i: {n.label for n in r.notices} for i, r in by_id.items()}
        assert labels[2] == {"cc-by-nc-4.0"} and labels[3] == {"apache-2.0"} and labels[5] == labels[6] == labels[12] == labels[None] == {"mit"} and labels[11] == {"gpl-3.0"}
        assert not any(labels[i] for i in (1, 4, 7, 8, 9, 10))
        assert by_id[5].notices[0].score == 1.0 and by_id[5].notices[0].start == 50 and 0 < by_id[6].notices[0].score < 1
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_weights_count_all_documents(spark):
    rows = [(k, "mit" if k % 4 == 0 else "license license", "en", "s") for k in range(400)]
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.PHRASES)
    docs = frame(spark, rows).repartition(7).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    assert license_scan._frequencies(docs, index) == (400, {b"mit": 100, b"license": 300})
