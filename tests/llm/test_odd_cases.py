"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tests.llm.data import frame, odd_rows, words
from trailsift.llm import byte_bpe, embedding_dedup, exact_dedup, html_extract, language_id, mixing, order_minhash, secrets, sharding, suffix_dedup

TARGETS = {"good": 0.8, "poor": 0.2}


def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, domain string")


def every_operator(spark, docs):
    some = labels(spark, [(1, "good"), (3, "good"), (14, "poor"), (15, "poor"), (None, "good"), (16, None), (7, "good"), (7, "poor")])
    yield "sharding", sharding.place(docs, 4)
    yield "language_id", language_id.identify(docs, per_language=5)
    yield "order_minhash", order_minhash.report(docs)
    yield "byte_bpe", byte_bpe.encode(docs, ranks(), public_tokenizers.PATTERN)
    yield "secrets", secrets.scan(docs, F.col("source"), F.col("lang"))
    yield "exact_dedup", exact_dedup.dedup_report(docs)
    yield "mixing", mixing.report(docs, some, TARGETS)
    yield "suffix_dedup", suffix_dedup.removed(docs)


def keeping(spark, docs):
    some = labels(spark, [(1, "good"), (14, "poor")])
    yield "language_id", language_id.known_language(docs, 0.0)
    yield "exact_dedup", exact_dedup.keep_one(docs)
    yield "order_minhash", order_minhash.keep_one(docs)
    yield "mixing", mixing.mix(docs, some, TARGETS)


@pytest.mark.parametrize("clashing", [False, True])
def test_one_row_for_each_row(spark, clashing):
    docs = frame(spark, odd_rows(), clashing)
    for name, found in every_operator(spark, docs):
        assert found.count() == len(odd_rows()), name


def test_empty_table(spark):
    docs = frame(spark, [])
    for name, found in [*every_operator(spark, docs), *keeping(spark, docs)]:
        assert found.count() == 0, name


def test_kept_rows_are_rows_of_the_input(spark):
    docs = frame(spark, odd_rows(), clashing=True)
    given = {tuple(r) for r in docs.collect()}
    for name, found in keeping(spark, docs):
        assert found.columns == docs.columns, name
        assert {tuple(r) for r in found.collect()} <= given, name


def test_sharding(spark):
    placed = sharding.place(frame(spark, odd_rows()), 4).collect()
    for shard in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))
    null = next(r for r in placed if r.id == 4)
    assert (null["size"], null.text_crc32) == (16, 0)


def test_language(spark):
    found = {r.id: r for r in language_id.identify(frame(spark, odd_rows()), per_language=5).collect()}
    for odd in (4, 5, 6, 12):
        assert (found[odd].lang_pred, found[odd].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = {r.doc_id for r in language_id.known_language(frame(spark, odd_rows()), 0.0).collect()}
    assert {1, 7, 14} <= kept and not {4, 5, 6, 12} & kept


def test_nothing_to_learn(spark):
    rows = [(i, t, None, s) for i, t, _, s in odd_rows()]
    assert {(r.lang_pred, r.score) for r in language_id.identify(frame(spark, rows)).collect()} == {("und", 0.0)}
    assert language_id.known_language(frame(spark, rows), 0.3).count() == len(rows)


def test_letters_of_all_planes(spark):
    astral = {50: ("\U0001f600\U0001f600", False), 51: ("\U0001d7d8 \U0001f1e9", False), 52: ("\U00010400\U00010401", True), 53: ("\U00020000", True)}
    rows = odd_rows() + [(k, t, None, "s") for k, (t, _) in astral.items()]
    found = {r.id: r.lang_pred for r in language_id.identify(frame(spark, rows), per_language=5).collect()}
    assert all((found[k] != "und") == letter for k, (_, letter) in astral.items())


def test_every_language_is_learned(spark):
    names = [f"l{k}" for k in range(80)]
    alphabet = [chr(0x3400 + 7 * k) + chr(0x3401 + 7 * k) + chr(0x3402 + 7 * k) for k in range(80)]
    docs = frame(spark, [(100 * k + n, words(k * 31 + n, 12, alphabet[k]), names[k], "s") for k in range(80) for n in range(12)])
    found = language_id.identify(docs).collect()
    assert all(r.lang_pred == names[r.id // 100] for r in found)
    assert language_id.known_language(docs, 0.3).count() == len(found)


def test_exact_copies(spark):
    found = exact_dedup.dedup_report(frame(spark, odd_rows())).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.id, []).append(r)
    assert by_id[2][0].keep_id == 1 and not by_id[2][0].kept
    # Longest original text of the group "same" is "s a m e"; three repeated rows go.
    assert {r.keep_id for r in by_id[9]} == {10} and by_id[10][0].kept and by_id[10][0].group_size == 4
    # Null, empty and blank texts are equal; the blank one is the longest.
    assert {r.keep_id for r in (*by_id[4], *by_id[5], *by_id[6])} == {6}
    kept = exact_dedup.keep_one(frame(spark, odd_rows())).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 3, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16]


def test_repeated_rows_keep_one(spark):
    docs = frame(spark, [(1, "x", "en", "s")] * 50 + [(None, "y", "en", "s")] * 20)
    assert sorted(r.text for r in exact_dedup.keep_one(docs).collect()) == ["x", "y"]
    assert exact_dedup.dedup_report(docs).filter("kept").count() == 2
    assert sorted(r.text for r in order_minhash.keep_one(docs).collect()) == ["x", "y"]


def test_near_copies(spark):
    found = {(r.id, r.keep_id, r.group_size) for r in order_minhash.report(frame(spark, odd_rows())).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 2), (8, 7, 2), (14, 14, 1)} <= found
    assert {r.doc_id for r in order_minhash.keep_one(frame(spark, odd_rows())).collect()} >= {1, 7, 14, 15, 16}


def test_tokens_of_odd_texts(spark):
    found = byte_bpe.encode(frame(spark, odd_rows()), ranks(), public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (0, [], empty, empty) for r in found if r.id in (4, 5))


def test_secrets_of_odd_texts(spark):
    found = {r.id: r for r in secrets.scan(frame(spark, odd_rows()), F.col("source"), F.col("lang")).collect()}
    assert found[11].base_text == "assign:0:23,access:28:48" and found[4].base_text == found[5].spans_text == ""


def test_owners_and_repositories(spark):
    token, example, spread = "aB3dE6gH9kL2mN5pQ8sT1vWx", "zY8xW5vU2tS9rQ6pO3nM1lKj", "qW1eR2tY3uI4oP5aS6dF7gHj"
    rows = [(k, token, f"l{k}", "one") for k in range(12)] + [(100 + k, example, "en", f"s{k}") for k in range(4)]
    rows += [(200 + k, spread, f"l{k // 2}", f"s{k % 2}") for k in range(10)]
    found = {r.id: r for r in secrets.scan(frame(spark, rows), F.col("source"), F.col("lang")).collect()}
    assert all(found[k].n_live == 1 and (found[k].held[0].owners, found[k].held[0].repositories) == (1, 12) for k in range(12))
    assert all(found[100 + k].n_live == 0 and found[100 + k].held[0].owners == 4 for k in range(4))
    assert all(found[200 + k].n_live == 0 and (found[200 + k].held[0].owners, found[200 + k].held[0].repositories) == (2, 10) for k in range(10))


def test_mixing_without_labels(spark):
    found = mixing.report(frame(spark, odd_rows()), labels(spark), TARGETS).collect()
    assert {tuple(r.steps) for r in found} == {(50, 50)}


def test_short_texts_stay_whole(spark):
    found = {r.id: r for r in suffix_dedup.removed(frame(spark, odd_rows())).collect()}
    assert (found[4].n_bytes, found[4].n_removed, found[4].n_spans) == (0, 0, 0)
    assert found[9].n_removed == 0 and found[2].n_removed == found[2].n_bytes and found[2].n_spans == 1


def test_vectors(spark):
    one = [1.0, 0.5, 0.0, -2.0]
    rows = [(1, one), (2, one), (2, [2.0, 1.0, 0.0, -4.0]), (3, None), (4, [0.0] * 4), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan")] * 4),
            (7, [1e30, float("inf"), 0.0, 0.0]), (8, [1.0]), (None, [0.0, 0.0, 1.0, 0.0]), (9, [-1.0, -0.5, 0.0, 2.0]), (10, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash")).withColumn("node", F.lit(1))
    found = sorted(((r.id, r.n_links, r.component_id) for r in embedding_dedup.dedup(docs).collect()), key=str)
    assert [f for f in found if f[0] in (1, 2)] == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]
    assert all(f[1] == 0 and f[2] == f[0] for f in found if f[0] not in (1, 2)) and len(found) == len(rows)
    assert embedding_dedup.dedup(docs.limit(0)).count() == 0


def test_vectors_of_all_lengths(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(100 * n + k, [rng.gauss(0, 1) for _ in range(n)]) for n, many in ((8, 60), (5, 30), (3, 4)) for k in range(many)]
    rows += [(i + 1_000_000, [x * 1.01 + 0.001 for x in v]) for i, v in rows] + [(7_000_000, rows[-1][1]), (8_000_000, [1.0] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {i: sum(len(v) == len(w) and i != j and cosine(v, w) >= 0.9 for j, w in rows) for i, v in rows}
    for block in (1_500, 20):  # one index; an index for each of two lengths
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        found = {r.id: r for r in embedding_dedup.dedup(docs).collect()}
        assert {i: r.n_links for i, r in found.items()} == want
        assert found[1_000_300].component_id == 300 and found[8_000_000].component_id == 8_000_000


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain <b>text"), (3, "not a url", "plain <b>text"), (None, "http://h/x", "<p>" + "w " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    found = sorted((str(r.id), r.text[:10], len(r.text)) for r in html_extract.extract(pages).collect())
    assert found == [("1", "", 0), ("2", "", 0), ("3", "plain text", 10), ("3", "plain text", 10), ("None", "w w w w w ", 399_999)]
    assert html_extract.extract(pages.limit(0)).count() == 0
