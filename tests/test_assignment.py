"""Greedy, one-by-one rules against loops that take the rows one by one."""

import hashlib
import os.path
import random

import pytest

from trailsift.operators import catalog as ca
from trailsift.operators import history as hi
from trailsift.operators import reconcile as rc


@pytest.mark.parametrize("seed", range(4))
def test_greedy_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"c{rng.randrange(12)}", f"s{rng.randrange(15)}") for i in range(60)] + [(100 + i, "c0", f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "pos bigint, content string, source string")
    taken_c, taken_s, expected = set(), set(), []
    for pos, c, s in sorted(rows):
        if c not in taken_c and s not in taken_s:
            expected.append(pos)
            taken_c.add(c)
            taken_s.add(s)
    assert sorted(r["pos"] for r in ca.greedy_pairs(df, "content", "source").collect()) == expected


def one_by_one(records, files):
    used, out = set(), {}
    sizes = dict(files)
    for pos, a, b, size in sorted(records):
        got = next((n for n in (a, b) if n in sizes and n not in used), None)
        if got is None and size:
            same = [n for n in sizes if n not in used and sizes[n] == size]
            got = same[0] if len(same) == 1 else None
        if got:
            used.add(got)
        out[pos] = got
    return out


@pytest.mark.parametrize("seed", range(8))
def test_assign_files_once(spark, seed):
    rng = random.Random(seed)
    files = [(f"f{i}", rng.randrange(1, 3 + seed)) for i in range(25)]

    def name():
        return rng.choice([None, None, "gone.jpg", *[f for f, _ in files]]) if seed % 2 else rng.choice([None, "gone.jpg", *[f for f, _ in files]])

    def size(a):
        own = dict(files).get(a)
        return own if own and rng.random() < 0.8 else rng.choice([None, 0, 1, 2, 3, 4, 5])

    records = [(i, a := name(), name(), size(a)) for i in range(60)]
    got = rc.assign_files_once(
        spark.createDataFrame(records, "pos bigint, a string, b string, file_size bigint"),
        spark.createDataFrame(files, "file_name string, file_size bigint"), ["a", "b"],
    )
    assert {r["pos"]: r["assigned"] for r in got.collect()} == one_by_one(records, files)


def assigned(spark, records, files):
    got = rc.assign_files_once(
        spark.createDataFrame(records, "pos bigint, a string, b string, file_size bigint"),
        spark.createDataFrame(files, "file_name string, file_size bigint"), ["a", "b"],
    )
    return [(r["pos"], r["assigned"]) for r in got.collect()]


def test_assignment_takes_no_round_for_each_record_of_a_chain(spark, monkeypatch):
    # Each record wants a file of the next size, which the record before it might have taken by size.
    n, cuts = 12, []
    files = [(f"f{i}", i) for i in range(1, n + 2)]
    records = [(n - i, f"f{i + 1}", None, i) for i in range(1, n + 1)]
    plain = rc.cut
    monkeypatch.setattr(rc, "cut", lambda df: cuts.append(1) or plain(df))
    assert dict(assigned(spark, records, files)) == one_by_one(records, files) == {n - i: f"f{i + 1}" for i in range(1, n + 1)}
    assert len(cuts) < 3 * n


def test_gifts_by_size_pass_on_losses(spark):
    rng = random.Random(5)
    records, files = [], []
    for k in range(150):  # sizes and names of their own, turns mixed
        own = [(f"f{k}_{i}", 10 * k + rng.randrange(1, 6)) for i in range(rng.randrange(1, 9))]
        names = [None, "gone.jpg", *[f for f, _ in own]]
        records += [(rng.random(), rng.choice(names), rng.choice(names), rng.choice([None, 0, *[10 * k + s for s in range(1, 6)]])) for _ in range(14)]
        files += own
    records = [(pos, *rest) for pos, (_, *rest) in enumerate(sorted(records, key=lambda r: r[0]))]
    assert dict(assigned(spark, records, files)) == one_by_one(records, files)


def test_assignment_of_rows_that_come_twice(spark):
    files = [("a", 1), ("a", 1), ("b", 2), ("c", 3), ("d", 3), (None, 4), ("e", None), ("g", 6), ("g", 6), ("h", 6)]
    records = [(0, "b", "b", 5), (0, "b", "b", 5), (1, None, None, 1), (2, "x/c", None, None), (3, None, None, 3), (3, None, None, 3), (4, "e", "d", 4), (None, "a", None, 1), (5, "g", None, 6), (6, None, None, 6)]
    got = assigned(spark, records, files)
    assert len(got) == len(records)  # where a file is listed twice, none is the only one of its size
    assert set(got) == {(0, "b"), (1, None), (2, "c"), (3, "d"), (4, "e"), (None, None), (5, "g"), (6, None)}


@pytest.mark.parametrize("seed", range(4))
def test_reconcile_late(spark, seed):
    rng = random.Random(seed)
    stems = ["ab", "abc", "scan12", "scan123456", "scan1234567", "x"]
    files = [(f"{rng.choice(['', 'p_'])}{rng.choice(stems)}{i}.tif", rng.choice([0, 5, 9])) for i in range(14)]
    records = [
        (i, rng.choice(["failed", "failed", "downloaded"]), f"https://h/item/{rng.randrange(30)}/", f"https://dl/{rng.choice(stems)}.tif", None)
        for i in range(24)
    ]
    done = {(p, u) for _, s, p, u, _ in records if s == "downloaded"}
    used, expected = set(), {}
    for pos, status, page, url, _ in records:
        if status != "failed" or (page, url) in done:
            continue
        stem = url.rsplit("/", 1)[1].removesuffix(".tif")
        free = [f for f, size in files if size > 0 and f not in used and stem in f.removesuffix(".tif").lower()]
        if len(free) == 1:
            used.add(free[0])
            expected[pos] = free[0]
    got = rc.reconcile_late(
        spark.createDataFrame(records, "pos bigint, status string, page_url string, url string, file_name string"),
        spark.createDataFrame(files, "file_name string, file_size bigint"), "https://h/item/",
    )
    assert {r["pos"]: r["file_name"] for r in got.collect()} == expected


def test_dedup_rules_in_order(spark):
    columns = "pos bigint, status string, image_url string, page_url string, sha256 string"

    def sha(n):
        return f"{n:064x}"

    old = spark.createDataFrame([(0, "downloaded", "https://h/i0", "https://h/p0", sha(1)), (1, "failed", "https://h/i1", "https://h/p1", sha(2))], columns)
    new = spark.createDataFrame(
        [
            (10, "", "https://h/i0", "https://h/p9", sha(9)),  # address known
            (11, "", "https://h/i9", "https://h/p9", sha(1)),  # content known
            (12, "", "https://h/i1", "https://h/p1", sha(2)),  # a failure is not known
            (13, "", "https://h/i7", "https://h/p7", sha(7)),  # content on disk
            (14, "", "https://h/i5", "https://h/p5", sha(2)),  # content of 12
            (15, "", "https://h/i1", "https://h/p1", sha(3)),  # source of 12
            (16, "", "https://h/i8", "https://h/p8", sha(3)),  # free again, since 15 was rejected
        ],
        columns,
    )
    files = spark.createDataFrame([(sha(7),)], "sha256 string")
    got = {r["pos"]: r["reason"] for r in ca.dedup_new(new, old, files).collect()}
    assert got == {10: "image_url", 11: "content", 12: None, 13: "file", 14: "content", 15: "source", 16: None}


def numbers_one_by_one(files, used):
    used = set(used)
    kept = {}
    for pos, own in sorted(files):
        if own is not None and own >= 1 and own not in used:
            kept.setdefault(own, pos)
    keeper = {pos: own for own, pos in kept.items()}
    reserved, out, top = used | set(kept), {}, max(used, default=0)
    for pos, _ in sorted(files):
        number = keeper.get(pos)
        if number is None:
            number = top + 1
            while number in reserved:
                number += 1
            reserved.add(number)
        top = max(top, number)
        out[pos] = number
    return out


@pytest.mark.parametrize("seed", range(5))
def test_recovered_files_keep_their_numbers(spark, seed):
    rng = random.Random(seed)
    files = [(k, rng.choice([None, None, rng.randint(0, 60), rng.randint(1, 30)])) for k in range(80)]
    used = [rng.randint(1, 40) for _ in range(rng.choice([0, 1, 15]))]
    got = ca.recover_sequences(spark.createDataFrame(files, "pos bigint, own bigint"), spark.createDataFrame([(n,) for n in used], "sequence bigint"))
    assert {r["pos"]: r["sequence"] for r in got.collect()} == numbers_one_by_one(files, used)


def test_recovery_of_nothing(spark):
    none = spark.createDataFrame([], "pos bigint, own bigint")
    assert ca.recover_sequences(none, spark.createDataFrame([(3,)], "sequence bigint")).count() == 0


def test_unique_paths(spark):
    rng = random.Random(2)

    def moved(folder, name, n):
        stem, suffix = os.path.splitext(name)
        digest = hashlib.sha1(f"{folder}/{name}".encode()).hexdigest()[:8]
        return f"{stem}_{digest}{f'_{n}' if n else ''}{suffix}"

    names = ["a.tif", "a", ".hidden", "b.tar.gz", "name with _12345678.tif", "c_d.e"]
    rows = [(k, rng.choice("xy"), rng.choice(names)) for k in range(120)]
    there = {("x", "a.tif"), ("y", "a"), ("x", moved("x", "a.tif", 0)), ("x", moved("x", "a.tif", 2)), ("y", moved("y", "b.tar.gz", 1)), ("y", moved("x", "a", 0))}
    rows += [(500, "x", moved("x", "c_d.e", 1))]  # stands in the data, so nobody else gets it
    taken, want = set(there) | {("x", rows[-1][2])}, {}
    for pos, folder, name in rows:
        options = [name] if pos == 500 or (folder, name) not in taken else [moved(folder, name, n) for n in range(len(rows) + 5)]
        want[pos] = next(o for o in options if pos == 500 or (folder, o) not in taken)
        taken.add((folder, want[pos]))
    got = hi.unique_paths(spark.createDataFrame(rows, "pos bigint, folder string, name string"), spark.createDataFrame(list(there), "folder string, name string"), "folder", "name", "pos")
    assert {r["pos"]: r["unique_name"] for r in got.collect()} == want and len({(f, want[p]) for p, f, _ in rows}) == len(rows)
