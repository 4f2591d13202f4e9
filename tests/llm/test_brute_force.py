"""Whole queries against plain Python on the small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import numpy as np
import pytest
import tiktoken

import public_tokenizers
from tests.llm.data import words
from trailsift.llm import byte_bpe, embedding_dedup, exact_dedup, html_extract, language_id, mixing, order_minhash, secrets, sharding, suffix_dedup
from trailsift.llm import grams as grams_of
from trailsift.llm.components import components
from trailsift.llm.queries import QUERIES
from trailsift.session import tune

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {d: (t or "", lang) for d, t, lang in duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()}


def run(spark, name, sf=SF):
    return QUERIES[name](tune(spark), sf).collect()


def test_shards_are_even_steps_of_the_key_order(spark, documents):
    found = {r.doc_id: r for r in run(spark, "op1_sharding")}
    order = sorted(documents, key=lambda d: (int(hashlib.md5(documents[d][0].encode()).hexdigest()[:15], 16), d))
    size = {d: len(documents[d][0].encode()) + 16 for d in order}
    total, at, firsts = sum(size.values()), 0, {}
    for n, d in enumerate(order):
        shard = (2 * at + size[d]) * 40 // (2 * total)
        firsts.setdefault(shard, n)
        assert (found[d]["size"], found[d].shard, found[d].slot) == (size[d], shard, n - firsts[shard])
        assert found[d].text_crc32 == zlib.crc32(documents[d][0].encode())
        at += size[d]


def test_overfull_ranges_are_subdivided(spark):
    rows = [(7, "copy " * 50)] * 3000 + [(k, words(k, 20)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.place(docs, 8)
    sizes = {r.shard: r.bytes for r in placed.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes").collect()}
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) < 600 for s in sizes.values())
    assert placed.select("shard", "slot").distinct().count() == 6000


def test_long_texts_and_repeats_keep_the_key_order(spark):
    rows = [(k, words(k, 20)) for k in range(3000)] + [(5000, words(1, 20_000)), (5001, words(2, 9_000))] + [(7, "copy " * 50)] * 300
    rows += [(6000 + k, "same text") for k in range(500)]
    placed = {}
    for r in sharding.place(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect():
        placed.setdefault((r.shard, r.slot), r.id)
    order = sorted(rows, key=lambda r: (int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), r[0]))
    assert len(placed) == len(rows) and [placed[k] for k in sorted(placed)] == [r[0] for r in order]


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    found = run(spark, "op2_language_id", sf)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    right = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.98


def test_languages_are_those_of_a_plain_kernel_ridge(documents):
    def grams(text):
        letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return {letters[i : i + n] for n in language_id.LENGTHS for i in range(len(letters) - n + 1)}

    known = [d for d in sorted(documents) if documents[d][0].strip() and documents[d][1]][:80]
    learned = [d for d in known if d % 3]
    sets = {d: grams(documents[d][0]) for d in known}
    alike = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    names = sorted({documents[d][1] for d in learned})
    signs = np.array([[1.0 if documents[d][1] == name else -1.0 for name in names] for d in learned])
    count = Counter(documents[d][1] for d in learned)
    penalty = np.diag([language_id.RIDGE * count[documents[d][1]] for d in learned])
    duals = np.linalg.solve(np.array([[alike(a, b) for b in learned] for a in learned]) + penalty, signs)
    plain = [names[int(np.argmax(np.array([alike(d, x) for x in learned]) @ duals))] for d in known]
    packed = {d: np.packbits(grams_of.presence([documents[d][0]], language_id.LENGTHS, True), axis=1)[0].tobytes() for d in known}
    model = language_id.fit([(documents[d][1], packed[d]) for d in learned], landmarks=len(names) * len(learned))
    marks = language_id._unpacked(model.landmarks).astype(np.float32).T
    margins = language_id.kernel(np.concatenate([language_id._unpacked(packed[d]) for d in known]), marks, marks.sum(0)) @ model.weights
    assert len(names) > 1 and [model.languages[k] for k in margins.argmax(1)] == plain


def test_near_copies_are_all_links(spark, documents):
    group = {r.doc_id: r.group_id for r in run(spark, "op3_order_minhash")}
    labels = {d: order_minhash.labels_of(" ".join(re.split(r"[\x09-\x0D ]+", t.lower().strip("\t\n\v\f\r ")))) for d, (t, _) in documents.items()}
    root = {d: d for d in documents}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(documents):
        for b in sorted(documents):
            if a < b and top(a) != top(b):
                common = len(np.intersect1d(labels[a], labels[b]))
                if common >= 0.8 * (len(labels[a]) + len(labels[b]) - common) - 1e-9 and order_minhash.aligned(labels[a], labels[b]):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    assert group == {d: top(d) for d in documents}


def test_alignment_needs_order():
    a = order_minhash.labels_of(words(1, 400))
    moved = order_minhash.labels_of(" ".join(words(1, 400).split()[200:] + words(1, 400).split()[:200]))
    assert order_minhash.aligned(a, a) and not order_minhash.aligned(a, moved)
    edited = words(1, 400).split()
    edited[50:52], edited[300:300] = ["new"], ["one", "two"]
    assert order_minhash.aligned(a, order_minhash.labels_of(" ".join(edited)))
    again = order_minhash.labels_of("a b c d e " * 40)
    assert len(set(again.tolist())) == len(again)


def test_many_near_copies_in_blocks(spark, monkeypatch):
    base = words(3, 150).split()
    rows = []
    for k in range(60):
        own = list(base)
        own[(k * 7) % 150] = f"edit{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, words(100 + k, 150)) for k in range(20)]
    monkeypatch.setattr(order_minhash, "BLOCK_LABELS", 2_000)
    found = order_minhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.keep_id for r in found if r.id < 1000} == {0} and all(r.keep_id == r.id for r in found if r.id >= 1000)


def test_near_copies_of_short_texts(spark):
    rows, near = [], []
    for n in range(5, 40):
        for edit in range(3):
            base = words(1000 * edit + n, n).split()
            other = {0: [*base, "extra"], 1: ["extra", *base], 2: [*base[:-1], "extra"]}[edit]
            a, b = order_minhash.labels_of(" ".join(base)), order_minhash.labels_of(" ".join(other))
            common = len(np.intersect1d(a, b))
            near.append(common >= 0.8 * (len(a) + len(b) - common) - 1e-9)
            if near[-1] and min(len(a), len(b)) <= order_minhash.SHORT:
                assert np.intersect1d(order_minhash.bands_of(a), order_minhash.bands_of(b)).size
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    found = {r.id: r.keep_id for r in order_minhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k - k % 2 if near[k // 2] else k for k in range(len(rows))}
    assert any(near[:12]) and not all(near[:12])  # both sides of the similarity


def test_tokens_are_those_of_the_library(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op4_byte_bpe"):
        text = documents[r.doc_id][0]
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    tokenizer = byte_bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    odd = ["a" * 3000, "ab" * 700, "\x1c \x1d\n\n  a  b\x85\x85 c", "日本語" * 300, "x​ y's 'll ½ ² ٣ \t\r\n ", "<|endoftext|>", "é" * 400, words(9, 1, "abcd") * 500]
    for text in odd:
        (ids, decoded), = tokenizer.code([text])
        assert ids == ",".join(map(str, encoding.encode_ordinary(text))) and decoded == text.encode()


def test_words_take_one_query_at_ranks_in_any_order():
    rng = np.random.default_rng(3)
    tokens = sorted({"".join(rng.choice(list("abc"), size)).encode() for size in rng.integers(2, 7, 400)})
    ranks = {bytes([b]): int(k) for b, k in enumerate(rng.permutation(256))} | dict(zip(tokens, map(int, 256 + 300 * rng.permutation(len(tokens))), strict=True))
    encoding = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer, queries = byte_bpe.Tokenizer(ranks, public_tokenizers.PATTERN), []

    class Counted:
        def __init__(self, db):
            self.register, self.run = db.register, db.sql

        def sql(self, query):
            queries.append(query)
            return self.run(query)

    tokenizer.db = Counted(tokenizer.db)
    words_of = ["x" + "".join(rng.choice(list("abc"), size)) for size in (*rng.integers(1, 60, 300), byte_bpe.LONG_WORD - 2, byte_bpe.LONG_WORD - 1)]
    text = " ".join(words_of)
    (ids, decoded), = tokenizer.code([text])
    assert ids == ",".join(map(str, encoding.encode_ordinary(text))) and decoded == text.encode()
    # One word of 257 bytes with its space goes by itself; all others are contracted and decoded together.
    assert len(queries) == 2 and sum("RECURSIVE" in q for q in queries) == 1


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return spans, ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_secrets(spark, documents):
    for r in run(spark, "op5_secret_scan"):
        spans, joined = base_spans(documents[r.doc_id][0])
        counts = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_odd_secrets_and_ownership(spark):
    texts = [
        'token=secret=abcdefgh12 token: token = "abcdefgh99"', "é🎉 API_KEY='x' apikey : ABCDEFGH+/= tail", "AKIA123AKIA" + "Z9" * 10 + " akia",
        "0" * 31 + " " + "f" * 40 + "g" + "a1" * 20, "password = short PASSWD:longenough1", "token" + "=" * 3 + "abcdefghij", "",
    ]
    live, copied = "Zx9" + "aB3dE5fG7hJ9kL1mN2pQ4r", "Qw7" + "eR5tY3uI1oP9aS7dF5gH3j"
    rows = [(k, t, f"o{k}", "r") for k, t in enumerate(texts)]
    rows += [(100, f"mine {live} end", "o1", "r"), *((200 + k, f"see {copied} here", f"o{k}", "r") for k in range(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    found = {r.id: r for r in secrets.scan(docs, docs["owner"], docs["repo"]).collect()}
    for k, text in enumerate(texts):
        assert found[k].base_text == base_spans(text)[1], text
    assert found[100].spans_text == f"live:5:{5 + len(live)}" and all(found[200 + k].spans_text == "" for k in range(6))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits, slots = exact_dedup.perfect_slots(keys)
    assert sorted(slots) == list(range(5000)) and (exact_dedup.slots_of(keys, sizes, bits) == slots).all()
    others = rng.integers(0, 2**63, (1000, 4)).astype(np.uint64)
    at = exact_dedup.slots_of(others, sizes, bits)
    held = np.empty_like(keys)
    held[slots] = keys
    assert not (held[at[at >= 0]] == others[at >= 0]).all(axis=1).any()


def test_any_history_gives_the_same_groups(spark):
    rows = exact_dedup.stored(exact_dedup.records(spark.read.parquet(f"{SF}/documents.parquet")), "digests")
    results = []
    for part in ("id < 0", "id % 3 = 0", "id >= 0"):
        found = exact_dedup.groups_of(rows, exact_dedup.F.expr(part)).select("digest", "n", "points", "id", "rid").collect()
        results.append(sorted((bytes(r.digest), r.n, r.points, r.id, r.rid) for r in found))
    assert results[0] == results[1] == results[2]


def test_mixture_meets_its_targets(spark):
    found = run(spark, "op7_mixing")
    tokens = np.array([r.n_tokens for r in found])
    posterior = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in found])
    rate = np.array([r.rate for r in found])
    got = (tokens * rate) @ posterior
    assert np.allclose(got / got.sum(), [0.93, 0.06, 0.01], atol=0.02) and rate.min() >= 0 and rate.max() <= 1
    sure = posterior.max(1) == 1
    assert all(r.copies in (0, 1) for r in found) and sure.any()


def test_rates_of_one_domain_too_many(spark):
    judged = spark.createDataFrame([([100, 0], 10)] * 50 + [([0, 100], 10)] * 150, "steps array<int>, tokens long")
    rates = mixing.fit_rates(judged, [0.5, 0.5])
    assert np.allclose(rates.of(np.array([[100, 0], [0, 100]])), [1, 1 / 3], atol=1e-3)
    rates = mixing.fit_rates(judged, [0.5, 0.5], budget=2000, most=10.0)
    assert np.allclose(rates.of(np.array([[100, 0], [0, 100]])), [2, 2 / 3], atol=1e-2)


def test_scarce_domains_cost_the_kept_one_nothing(spark):
    pure = np.array([[100, 0, 0], [0, 100, 0], [0, 0, 100]])
    for supply in ((9700, 100, 200), (9600, 390, 10), (9990, 5, 5)):
        judged = spark.createDataFrame([(p.tolist(), n) for p, n in zip(pure, supply, strict=True)], "steps array<int>, tokens long")
        rate = mixing.fit_rates(judged, [0.93, 0.06, 0.01], kept=[0]).of(pure)
        assert rate[0] == 1 and rate[1] == 1 and rate[2] <= 1


def test_rare_domains_reach_their_targets(spark):
    pure = np.array([[100, 0, 0], [0, 100, 0], [0, 0, 100]])
    blurred = np.array([[96, 2, 2], [60, 30, 10], [10, 80, 10], [20, 5, 75], [0, 50, 50]])
    for steps, tokens in ((pure, (94_000, 3_000, 3_000)), (pure, (97_000, 1_000, 2_000)), (blurred, (90_000, 3_000, 4_000, 2_000, 1_000))):
        judged = spark.createDataFrame([(p.tolist(), n) for p, n in zip(steps, tokens, strict=True)], "steps array<int>, tokens long")
        supply = np.array(tokens) @ steps / 100
        wanted = np.minimum(supply, supply[0] / 0.93 * np.array([0.93, 0.06, 0.01]))
        rate = mixing.fit_rates(judged, [0.93, 0.06, 0.01], kept=[0]).of(steps)
        best = np.ones(len(steps))
        for _ in range(50_000):
            best = np.clip(best - steps / 100 @ (((np.array(tokens) * best) @ steps / 100 - wanted) / supply), 0, 1)
        got, ideal = (np.array(tokens) * rate) @ steps / 100, (np.array(tokens) * best) @ steps / 100
        assert (np.abs(got - ideal) <= 0.02 * wanted + 1e-6).all()


def test_labels_of_documents_at_hand_are_learned(spark):
    text = {"good": "abcdef", "poor": "uvwxyz"}
    domain = {k: "poor" if k % 100 == 0 else "good" for k in range(3000)}
    labels = spark.createDataFrame(list(domain.items()), "doc_id long, domain string")
    docs = spark.createDataFrame([(k, words(k, 20, text[d])) for k, d in domain.items() if k % 10 == 0], "doc_id long, text string")
    counts = mixing.quotas({"good": 270, "poor": 30}, 60)
    assert counts == {"poor": 30, "good": 30} and mixing.quotas({"good": 270, "poor": 3}, 60) == {"poor": 3, "good": 57}
    model = mixing.learn(docs, labels, ["good", "poor"], labelled=60)
    assert np.allclose(model.prior, [0.9 / 0.5, 0.1 / 0.5])  # 30 texts of each were learned from
    judged = {r.id: r.steps for r in mixing.posteriors(docs, model).collect()}
    assert all((s[1] > 50) == (domain[k] == "poor") for k, s in judged.items())
    unlabelled = docs.filter("doc_id % 100 != 0")
    for some in (labels.filter("doc_id < 0"), labels):
        assert mixing.mix(unlabelled, some, {"poor": 0.5, "good": 0.5}).count() == unlabelled.count()


def brute_links(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    return close.sum(1), embedding_dedup._forest(*np.nonzero(close), len(vectors))


def test_vector_links(spark):
    found = sorted(run(spark, "op8_embedding_dedup"), key=lambda r: r.vec_id)
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    links, root = brute_links(np.array([v for _, v in rows]))
    assert [r.n_links for r in found] == links.tolist() and [r.component_id for r in found] == [rows[k][0] for k in root]


def test_vector_recall_in_lists_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    vectors = np.concatenate([centres[rng.integers(0, 150, 1500)] + rng.normal(scale=0.22, size=(1500, 32)), np.tile(centres[:1], (200, 1)), rng.normal(size=(800, 32))])
    vectors = vectors.astype(np.float32)
    for name, value in (("LIST_SIZE", 64), ("BLOCK", 100)):
        monkeypatch.setattr(embedding_dedup, name, value)
    docs = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    found = sorted(embedding_dedup.dedup(docs).collect(), key=lambda r: r.id)
    links, root = brute_links(vectors.astype(float))
    got = np.array([r.n_links for r in found])
    assert (got <= links).all() and got.sum() / links.sum() >= 0.97
    assert np.mean([r.component_id == k for r, k in zip(found, root, strict=True)]) >= 0.97


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in root.items() if k != v}


def removed_by_hand(texts):
    seen = Counter(d[k : k + 200] for d in texts.values() for k in range(len(d) - 199))
    out = {}
    for key, data in texts.items():
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - 199):
            if seen[data[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[1:-1]])
        out[key] = (len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("contexts", [1_000, 1])
def test_repeated_bytes(spark, documents, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    texts = {d: t.encode() for d, (t, _) in documents.items()}
    passage, loop = words(50, 60), "abcabcab" * 60
    texts |= {10_000 + k: f"{words(60 + k, 30)} {passage[k : 260 + 3 * k]} {words(90 + k, 30)}".encode() for k in range(25)}
    texts |= {20_000: loop.encode(), 20_001: ("é" * 150 + words(1, 50) + "é" * 150).encode(), 20_002: passage[:199].encode(), 20_003: passage[:200].encode()}
    docs = spark.createDataFrame([(d, t.decode(errors="ignore")) for d, t in texts.items()], "doc_id long, text string")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    found = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    assert found == removed_by_hand(texts)


def test_transform_search():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([rng.integers(0, 3, 300), [5], rng.integers(0, 3, 300), [6]])
    symbols[400:460] = symbols[100:160]
    order = suffix_dedup.suffix_order(symbols, 1024)
    text = symbols.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    for least in (1, 4, 30):
        long = suffix_dedup.long_neighbours(symbols, order, least)
        want = [False] + [text[a : a + least] == text[b : b + least] and len(text) - max(a, b) >= least for a, b in zip(order[:-1], order[1:], strict=True)]
        assert long.tolist() == want


def test_search_takes_many_bytes_a_level(monkeypatch):
    rng = np.random.default_rng(5)
    common = rng.integers(0, 4, 250)
    parts = [np.concatenate([common[k % 40 : 215 + k], rng.integers(0, 4, 20), [300 + k]]) for k in range(30)]
    symbols = np.concatenate(parts)
    levels, sort = [], suffix_dedup._ranks_in
    monkeypatch.setattr(suffix_dedup, "_ranks_in", lambda values, bits: levels.append(len(values)) or sort(values, bits))
    order = suffix_dedup.suffix_order(symbols, 512)
    text = symbols.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    for least, most in ((200, 10), (207, 17), (13, 13)):
        levels.clear()
        long = suffix_dedup.long_neighbours(symbols, order, least)
        assert long.tolist() == [False] + [text[a : a + least] == text[b : b + least] for a, b in zip(order[:-1], order[1:], strict=True)]
        assert long.any() and len(levels) <= most


def test_pages(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    found = {r.page_id: r for r in run(spark, "op10_html_extraction")}
    for page, url, html in pages:
        inside = html[html.index("<article>") + 9 : html.index("</article>")]
        blocks = (" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", " ", inside)))
        want = "\n\n".join(b for b in blocks if b)
        assert (found[page].url, found[page].text, found[page].n_chars) == (url, want, len(want))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="post post-%d"><h1>Head &amp; line</h1><p>First   part<br>of %d <b>bold<p>Second &#233; part with <a href="#">a link</a>
<script>if (a < b) document.write("</div><p>no</p>")</script><div class="ad-slot">Buy now</div><ul><li>one<li>two</ul><form><label>Mail</label><input></form></div>
<aside>Side %s</aside><section id="comments"><h2>Comments</h2><article class="comment"><p>A reader's words, many of them, more than the post itself has</p></article></section>
<footer>End</footer></body></html>"""


def test_consensus_of_a_host(spark):
    rows = [(k, "https://h.example/a", PAGE % (k, k, "bar " * 30)) for k in range(5)]
    rows.append((9, "https://h.example/b", "<body><div class='post post-9'><p>Short.</p></div><div class='other'>" + "Also. " * 3 + "</div></body>"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.id: r for r in html_extract.extract(docs).collect()}
    for k in range(5):
        assert found[k].text == f"Head & line\n\nFirst part of {k} bold\n\nSecond é part with a link\n\none\n\ntwo"
    assert {r.path for r in found.values()} == {"body>div.post.post-#"}


def test_headings_and_leads_outside_the_body_stay():
    nav, body = "<div class='nav'><p>Go</p></div><ul><li><a href='/'>Home</a></ul>", "<p>" + "Body text. " * 30 + "</p>"
    want = ["Title", "A lead.", ("Body text. " * 30).strip()]
    for page in (
        f"<body>{nav}<div class=post><h1>Title</h1><p>A lead.</p><div class=body>{body}</div></div>",
        f"<body>{nav}<div class=post><h1><a href='/1'>Title</a></h1><p>A lead.</p><div class=body>{body}</div></div>",
        f"<body>{nav}<main><h1>Title</h1><section><p>A lead.</p></section><article>{body}</article></main>",
        f"<body>{nav}<h1>Title</h1><div><p>A lead.</p></div><article>{body}</article>",
    ):
        for path in (None, "body>div.post>div.body", "body>main>article", "body>article"):
            blocks = html_extract.Page(page).text(path).split("\n\n")
            assert [b for b in blocks if b not in ("Home", "Go")] == want


BODY = "Body text of the post. " * 8
COMMENT = "<p>" + "A reader says a lot about it. " * 40 + "</p>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article><header class='entry-header'><h1>Title</h1></header><p>{BODY}</article>", ["Title", BODY]),
        (f"<article><div class='entry-header'><h1>Title</h1><p>Lead.</p></div><p>{BODY}</article>", ["Title", "Lead.", BODY]),
        (f"<header><h1>Site</h1></header><div class='post'><header><h1>Title</h1></header><p>{BODY}</div><footer>End</footer>", ["Title", BODY]),
        (f"<div class='post'><header><h2>Title</h2><p>Lead.</header><div class='body'><p>{BODY}</div></div>", ["Title", "Lead.", BODY]),
        (f"<div id='page'><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><div class='post'><p>{BODY}</div></div>", [BODY]),
        (f"<div class='site-header'><h1>Site</h1></div><div class='post'><p>{BODY}</div>", [BODY]),
        (f"<div class='post'><p>Short post.</div><div class='comments'>{COMMENT}</div>", ["Short post."]),
        (f"<div class='post'><p>Short post.</div><div id='comments-area'><article>{COMMENT}</article></div>", ["Short post."]),
        (f"<article><p class='social'>{BODY}<div class='search-results'><p>Found.</div></article>", [BODY, "Found."]),
        (f"<ul class='menu'><li>Menu words</ul><article class='post has-sidebar'><h1>T</h1><p>{BODY}</article><div class='post-comments'>{COMMENT}</div>", ["T", BODY]),
        (f"<div class='sidebar'><article><p>{BODY}</article></div>", [BODY]),
        (f"<article><p>{BODY}<p class='ad'>Buy</p><div class='cookie-notice'>Cookies</div><div class='related-posts'><p>More</p></div></article>", [BODY]),
        (f"<div class='comments'>{COMMENT}</div><footer>End</footer>", []),
    ],
)
def test_titles_stay_and_comments_go(html, want):
    assert html_extract.Page(html).text(None) == "\n\n".join(" ".join(b.split()) for b in want)


def test_deep_pages():
    for html in ("<b>" * 20_000 + "x", "<div>" * 20_000 + "x", "</p>" * 1000 + "<" * 1000 + "x", "<p " + "a='" * 500):
        html_extract.Page(html).text(None)
    assert html_extract.Page("<div>" * 2000 + "x").text(None) == "x"


def test_pipeline_keeps_what_each_stage_says(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = exact_dedup.stored(stage(tune(spark), before, SF), name)
        counts[name] = docs.count()
        if name == "exact_dedup":
            squeezed = {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in before.collect()}
            assert counts[name] == len(squeezed)
        if name == "order_minhash":
            assert counts[name] == before.join(order_minhash.report(before).filter("id = keep_id").withColumnRenamed("id", "doc_id"), "doc_id").count()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < counts["byte_bpe"] == counts["mixing"] <= counts["order_minhash"] <= counts["exact_dedup"] <= counts["language_id"]
