"""Byte-level BPE: recursive queries contract the distinct words of a partition, an ordered aggregate decodes.

A text is cut into words by the tokenizer's pattern.  The words that a task has not seen yet become rows (word, position, token) of
their bytes; a recursive query joins neighbours with the merge table and contracts the leftmost pair of the least rank of each word
until no word has a pair left.  The ids of a word are its tokens in order of position; decoding joins ids with the vocabulary and
puts the bytes together in order, in the same query.  Each worker keeps the words it has used lately, up to a bound.  No shuffle.

A word of more than ``LONG_WORD`` bytes takes the same contractions from a heap, since a recursive query contracts one pair a round.

Defined results: a null text counts as empty and has no ids; repeated rows each get the full result; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import KEPT, pieces

USER = "byte_bpe"
LONG_WORD = 256  # bytes
KEPT_WORDS = 300_000  # words in use after which a task forgets those that were not used since it last did so
ROUND_WORDS = 30_000  # words of one recursive query
CHUNK_CHARS = 3_000_000  # texts are taken together up to this size; a longer text is taken alone and whole
# White space as the tokenizer's own regex engine has it (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A token row has its place and size in bytes, the next token of its word, and their pair: rank, then place and size of the left token
# (at most ``LONG_WORD``) in one number.  Contracting a pair changes its right row and the row before it; the left row goes.  A word
# without a pair is done and takes part in no further round.
NEXT_RANK = 1 << 40
NEXT_PLACE = 1 << 9
PLACES = NEXT_RANK // NEXT_PLACE
FIRST_TOKEN = 1 << 32

# Ids and bytes of the words whose tokens are known.
DECODE = """
SELECT word, array_to_string(list(name ORDER BY place), ',') AS ids, array_to_string(list(hex ORDER BY place), '') AS hex
FROM tokens JOIN vocabulary ON id = token GROUP BY word ORDER BY word
"""
CONTRACT = f"""
WITH RECURSIVE state(word, place, size, token, next, pair, done) AS (
  SELECT word, place, 1, token, next, m.rank * {NEXT_RANK}::BIGINT + place * {NEXT_PLACE}::BIGINT + 1, false
  FROM letters LEFT JOIN merges m ON m.tokens = token * {FIRST_TOKEN}::BIGINT + next
  UNION ALL
  (
    WITH best AS (
      SELECT word, (pair // {NEXT_RANK})::INTEGER AS merged, (pair // {NEXT_PLACE} % {PLACES})::INTEGER AS first,
        (pair // {NEXT_PLACE} % {PLACES} + pair % {NEXT_PLACE})::INTEGER AS second
      FROM (SELECT word, min(pair) AS pair FROM state WHERE NOT done GROUP BY word)
    ), met AS (
      SELECT s.word, s.place, s.size, s.token, s.next, s.pair, merged, first, place = second AS grows, place + size = first AS precedes
      FROM state s JOIN best b ON b.word = s.word WHERE NOT done AND place IS DISTINCT FROM first
    ), moved AS (
      SELECT word, CASE WHEN grows THEN first ELSE place END AS place, CASE WHEN grows THEN size + place - first ELSE size END AS size,
        CASE WHEN grows THEN merged ELSE token END AS token, CASE WHEN precedes THEN merged ELSE next END AS next,
        pair, grows OR precedes AS changed, merged IS NULL AS done
      FROM met
    )
    SELECT word, place, size, token, next, CASE WHEN changed THEN m.rank * {NEXT_RANK}::BIGINT + place * {NEXT_PLACE}::BIGINT + size ELSE pair END, done
    FROM moved LEFT JOIN merges m ON m.tokens = CASE WHEN changed THEN token * {FIRST_TOKEN}::BIGINT + next END
  )
), tokens AS (SELECT word, place, token FROM state WHERE done)
{DECODE}
"""


def read_ranks(path: str) -> bytes:
    """The rank file, to be shipped to the tasks; its size is that of a vocabulary, whatever the corpus."""
    with open(path, "rb") as file:
        return file.read()


@dataclass
class Tokenizer:
    """Words to ids and back, for one worker."""

    ranks: dict[bytes, int]
    pattern: str
    coded: dict[str, str] = field(default_factory=dict)  # word: ids joined by commas
    older: dict[str, str] = field(default_factory=dict)  # the same of words not used lately
    changed: dict[str, bytes] = field(default_factory=dict)  # what the ids decode to, where that is not the word

    def __post_init__(self) -> None:
        self.words = regex.compile(self.pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        merges = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items() for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        first, second, rank = (np.array(c, np.int64) for c in zip(*merges, strict=True))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        merge_rows = pa.table({"tokens": first * FIRST_TOKEN + second, "rank": rank.astype(np.int32)})
        ids = list(self.ranks.values())
        token_rows = pa.table({"id": pa.array(ids, pa.int32()), "name": list(map(str, ids)), "hex": [t.hex() for t in self.ranks]})
        for name, rows in (("merges", merge_rows), ("vocabulary", token_rows)):
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")

    def learn(self, words: list[str]) -> None:
        """Encode and decode words not seen before; a word that is a token is left whole."""
        whole = [w for w in words if w.encode() in self.ranks]
        if whole:
            self._decode(whole, [[self.ranks[w.encode()]] for w in whole])
            words = [w for w in words if w.encode() not in self.ranks]
        short = [w for w in words if len(w.encode()) <= LONG_WORD]
        for k in range(0, len(short), ROUND_WORDS):
            self._contract(short[k : k + ROUND_WORDS])
        if len(short) < len(words):
            for word in set(words) - set(short):
                self._decode([word], [self._from_heap(word.encode())])

    def _contract(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        sizes = np.array([len(b) for b in coded])
        token = self.single[np.frombuffer(b"".join(coded), np.uint8)]
        last = np.zeros(len(token), bool)
        last[np.cumsum(sizes) - 1] = True
        self.db.register("letters", pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "place": np.arange(len(token), dtype=np.int32),
            "token": token, "next": pa.array(np.roll(token, -1), mask=last),
        }))
        self._keep(words, CONTRACT)

    def _decode(self, words: list[str], ids: list[list[int]]) -> None:
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(i) for i in ids])
        token = np.concatenate([np.array(i, np.int32) for i in ids])
        self.db.register("tokens", pa.table({"word": owner, "place": np.arange(len(owner)), "token": token}))
        self._keep(words, DECODE)

    def _keep(self, words: list[str], query: str) -> None:
        found = self.db.sql(query).to_arrow_table()
        self.coded.update(zip(words, found["ids"].to_pylist(), strict=True))
        for word, hexed in zip(words, found["hex"].to_pylist(), strict=True):
            if word.encode() != (decoded := bytes.fromhex(hexed)):
                self.changed[word] = decoded

    def _from_heap(self, word: bytes) -> list[int]:
        """The contractions of ``CONTRACT`` for one long word: pairs wait in a heap by rank, then place."""
        tokens: list[bytes | None] = [word[k : k + 1] for k in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def wait(k: int) -> None:
            if k >= 0 and after[k] < len(word):
                pair = tokens[k] + tokens[after[k]]
                if pair in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], k, pair))

        for k in range(len(word)):
            wait(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            # A pair that lost a side to another contraction is out of date.
            if tokens[k] is None or after[k] >= len(word) or len(tokens[k]) + len(tokens[after[k]]) != len(pair) or not pair.startswith(tokens[k]):
                continue
            gone = after[k]
            tokens[k], tokens[gone], after[k] = pair, None, after[gone]
            if after[k] < len(word):
                before[after[k]] = k
            wait(k)
            wait(before[k])
        return [self.ranks[t] for t in tokens if t is not None]

    def code(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Per text: ids joined by commas, and the bytes that they decode to."""
        cut = [self.words.findall(t) for t in texts]
        if len(self.coded) > KEPT_WORDS:
            self.older, self.coded = self.coded, {}
        new = set().union(*cut).difference(self.coded)
        for word in new & self.older.keys():
            self.coded[word] = self.older.pop(word)
        self.learn(sorted(new - self.coded.keys()))
        for words in cut:
            plain = b"".join([self.changed.get(w, w.encode()) for w in words]) if self.changed else "".join(words).encode()
            yield ",".join(map(self.coded.__getitem__, words)), plain


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def _tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """Kept by a Python worker from task to task, with the words that it knows."""
    key, known = KEPT.get(USER, (None, None))
    if key != (ranks, pattern):
        known = Tokenizer(parse_ranks(ranks), pattern)
        KEPT[USER] = (ranks, pattern), known
    return known


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: id, ``n_tokens``, ``ids`` (unless left out), their SHA-256 joined by commas, and that of the decoded bytes."""
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([asked.schema["id"], T.StructField("n_tokens", T.LongType()), *ids_field,
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(ranks, pattern)
        for batch in pieces(batches, user=USER):
            counts, ids, coded, plain = [], [], [], []
            for chunk in _chunks([t or "" for t in batch["text"].to_pylist()]):
                for joined, decoded in tokenizer.code(chunk):
                    counts.append(joined.count(",") + 1 if joined else 0)
                    coded.append(hashlib.sha256(joined.encode()).hexdigest())
                    plain.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
            lists = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64()), *lists, pa.array(coded, pa.string()), pa.array(plain, pa.string())], schema.names)

    return asked.mapInArrow(run, schema)
