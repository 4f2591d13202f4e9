"""Blocked scans against plain loops, with a hot key and blocks of every size."""

import random

import pytest
from pyspark.sql import functions as F

from trailsift.operators import catalog as ca
from trailsift.operators import methodlock
from trailsift.plans import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = ["hot"] * 60 + ["a", "b", "c", None] * 10
    positions = rng.sample(range(400), len(keys))
    return [(k, p, rng.choice([None, 1, 2, 3])) for k, p in zip(keys, positions)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_scan(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    block = ordered.position_block("p", size)
    out = ordered.scan(
        df, ["k"], ["p"], block,
        [
            ordered.Scan("total", "sum", F.col("v")), ordered.Scan("top", "max", F.col("v")), ordered.Scan("low", "min", F.col("v")),
            ordered.Scan("seen", "last", F.col("v")), ordered.Scan("ahead", "sum", F.col("v"), before=True),
        ],
    )
    out = ordered.previous(out, ["k"], ["p"], block, {"lagged": F.col("v")})
    got = {(r["k"], r["p"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        past, lagged = [], None
        for _, p, v in sorted(r for r in rows if r[0] == key):
            known = [x for x in past if x is not None]
            with_own = known + ([v] if v is not None else [])
            r = got[key, p]
            assert (r["total"], r["ahead"]) == (sum(with_own), sum(known))
            assert (r["top"], r["low"]) == (max(with_own, default=None), min(with_own, default=None))
            assert (r["seen"], r["lagged"]) == (with_own[-1] if with_own else None, lagged)
            past.append(v)
            lagged = v


@pytest.mark.parametrize("block_rows", [3, 5, 100])
def test_rolling_list(spark, block_rows):
    df = spark.createDataFrame([("a", i * 3, str(i % 5)) for i in range(50)], "k string, p bigint, v string")
    out = ordered.rolling_list(df, ["k"], ["p"], ordered.position_block("p", 10), F.col("v"), 4, "w", block_rows)
    for r in out.collect():
        i = r["p"] // 3
        assert r["w"] == [str(j % 5) for j in range(max(0, i - 3), i + 1)]


def test_island_ordinal(spark):
    df = spark.createDataFrame([(i, i % 7 == 3) for i in range(40)], "p bigint, s boolean").withColumn("k", F.lit(1))
    out = ordered.island_ordinal(df, ["k"], ["p"], ordered.position_block("p", 6), F.col("s"), "n")
    assert {r["p"]: r["n"] for r in out.collect()} == {i: 0 if i < 3 else (i - 3) % 7 + 1 for i in range(40)}


def test_text_block_keeps_the_order(spark):
    names = [f"item_{i}_x" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = ordered.number_rows(df, [], ["n"], ordered.text_block(df, "n", 10), "nth")
    assert [r["n"] for r in sorted(out.collect(), key=lambda r: r["nth"])] == sorted(names)


def test_missing_numbers(spark):
    used = spark.createDataFrame([(1,), (2,), (5,), (9,), (9,), (40,)], "n bigint")
    assert sorted(r["n"] for r in ca.missing_numbers(used, "n", 12).collect()) == [3, 4, 6, 7, 8, 10, 11, 12]
    assert ca.missing_numbers(used, "n", 2).count() == 0
    assert sorted(r["n"] for r in ca.missing_numbers(used.limit(0), "n", 3).collect()) == [1, 2, 3]


@pytest.mark.parametrize("used", [[], [1, 2, 3], [2, 4, 6, 7, 30], [5]])
def test_assign_sequences(spark, used):
    new = spark.createDataFrame([(p,) for p in (4, 9, 11, 70, 71)], "pos bigint")
    taken = spark.createDataFrame([(n,) for n in used], "sequence bigint")
    got = {r["pos"]: r["sequence"] for r in ca.assign_sequences(new, taken, 2).collect()}
    expected, number = {}, 2
    for p in (4, 9, 11, 70, 71):
        while number in used:
            number += 1
        expected[p] = number
        number += 1
    assert got == expected


@pytest.mark.parametrize("block_rows", [4, 16, 1000])
def test_method_lock(spark, block_rows):
    rng = random.Random(3)
    methods = ["m0", "m1", "m2"]
    events = [("s%d" % (i % 5 == 0), i, methods[min(2, int(rng.expovariate(1.4)))], rng.random() < 0.85) for i in range(160)]
    df = spark.createDataFrame(events, "site string, pos bigint, method string, ok boolean")
    got = {(r["site"], r["pos"]): (r["streak"], r["preferred"]) for r in methodlock.method_lock(df, methods, block_rows=block_rows).collect()}
    state = {}
    for site, pos, method, ok in events:
        last, run, preferred = state.get(site, (None, 0, None))
        if ok:
            run = run + 1 if method == last else 1
            last = method
            preferred = method if run >= 5 else preferred
        elif preferred == method:
            preferred, run = None, 0
        state[site] = (last, run, preferred)
        assert got[site, pos] == (run, preferred), (site, pos)


def test_one_outlier_does_not_make_one_block(spark):
    names = [f"image_{k:08d}.jpg" for k in range(5000)] + ["Zebra.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    sizes = df.groupBy(ordered.text_block(df, "n", 100).alias("b")).count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) < 500
