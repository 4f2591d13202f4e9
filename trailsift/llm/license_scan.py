"""Licence scan by a positional index of rare words.

Words are runs of ASCII letters (lower-cased), digits and anything beyond ASCII, numbered from 0.  Two kinds of finds:

* Base phrases: every place where the words of a phrase stand one after another.
* Templates: short licence notices with mandatory key phrases.  How many documents of the whole corpus hold each template word gives the
  word's weight (inverse document frequency, in thousandths).  In a file, the ``RARE`` rarest of its words are looked up for each template;
  every occurrence at p of a word that stands at q in the template says that the template starts at p - q.  Starts on which ``AGREE`` of
  these words agree (all, if the file holds fewer) are candidates.  A candidate counts if every key phrase of the template stands whole
  between ``SLACK`` words before it and ``SLACK`` words behind it; its score is the weight of the words that stand in their places, over
  the weight of all.

The index is as large as the templates and travels with the tasks; texts are never shuffled.  Document frequencies are one small
aggregate: a row per template word and batch.  Work grows with the words of a text and the lookups of its rare words.

Defined results: a null or empty text has no words; a base phrase scores 1; a text without finds scores 0 and has no labels; repeated
rows each get their full result; a very long text is one row of one task; an empty table gives an empty result; other columns are never
looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import pieces

RARE = 4
AGREE = 2
SLACK = 8

# Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


class Template(NamedTuple):
    label: str
    text: str
    keys: Sequence[str]


# Customary licence notices, and the phrases without which they are not the notice.
TEMPLATES = [
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
             ["except in compliance with the license", "apache org licenses license 2 0"]),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
             ["redistribution and use in source and binary forms", "following conditions are met"]),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission",
             ["endorse or promote products", "without specific prior written permission"]),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial 4 0"]),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike 4 0"]),
    Template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0 universal"]),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
             ["gnu general public license", "either version 2 of the license"]),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
             ["for any purpose with or without fee is hereby granted"]),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    Template("mit", "Released under the MIT License", ["mit license"]),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
             ["permission is hereby granted free of charge", "associated documentation files"]),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

# ASCII letters and digits and all bytes of characters beyond ASCII are parts of words.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def standing(words: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
    """Places from ``low`` to ``high`` where the phrase's words stand one after another."""
    last = len(words) - len(phrase)
    high = last if high is None else min(high, last)
    found, at = [], max(low, 0) - 1
    while True:
        try:
            at = words.index(phrase[0], at + 1, high + 1) if at < high else -1
        except ValueError:
            return found
        if at < 0:
            return found
        if words[at : at + len(phrase)] == phrase:
            found.append(at)


def weight(documents: int, holding: int) -> int:
    """Inverse document frequency in thousandths, 1 at least."""
    return 1 + math.floor(1000 * math.log((documents + 1) / (holding + 1)))


class Index:
    """Postings of all template words, their corpus frequencies, and the base phrases."""

    def __init__(self, templates: Sequence[Template], phrases: Sequence[tuple[str, str]]) -> None:
        self.labels = [t.label for t in templates]
        self.texts = [words_of(t.text.encode()) for t in templates]
        self.keys = [[words_of(key.encode()) for key in t.keys] for t in templates]
        self.needed = [set().union(*keys) for keys in self.keys]
        self.distinct = [set(text) for text in self.texts]
        self.vocabulary = frozenset().union(*self.distinct)
        self.postings: list[dict[bytes, list[int]]] = []
        for text in self.texts:
            places = defaultdict(list)
            for q, word in enumerate(text):
                places[word].append(q)
            self.postings.append(places)
        self.phrases = [(words_of(phrase.encode()), label) for phrase, label in phrases]
        self.order: dict[bytes, int] = {}
        self.weights: dict[bytes, int] = {}

    def weigh(self, documents: int, holding: dict[bytes, int]) -> Index:
        self.weights = {w: weight(documents, holding.get(w, 0)) for w in self.vocabulary}
        rarest = sorted(self.vocabulary, key=lambda w: (holding.get(w, 0), w))
        self.order = {w: k for k, w in enumerate(rarest)}
        return self

    def base(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, str]]:
        return sorted((at, label) for phrase, label in self.phrases if present.issuperset(phrase) for at in standing(words, phrase))

    def notices(self, words: list[bytes], held: set[bytes]) -> Iterator[tuple[int, str, float]]:
        """(start, label, score) of every verified template; ``held`` are the template words of the file."""
        asked = [t for t, needed in enumerate(self.needed) if needed <= held]
        if not asked:
            return
        rare = {t: sorted(held & self.distinct[t], key=self.order.__getitem__)[:RARE] for t in asked}
        lookups = set().union(*rare.values())
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, word in enumerate(words):
            if word in lookups:
                places[word].append(p)
        for t in asked:
            agreeing = Counter(start for w in rare[t] for start in {p - q for p in places[w] for q in self.postings[t][w]})
            text, total = self.texts[t], sum(map(self.weights.__getitem__, self.texts[t]))
            for start in sorted(s for s, n in agreeing.items() if n >= min(AGREE, len(rare[t]))):
                if all(standing(words, key, start - SLACK, start + len(text) + SLACK) for key in self.keys[t]):
                    same = sum(self.weights[w] for q, w in enumerate(text) if 0 <= start + q < len(words) and words[start + q] == w)
                    yield start, self.labels[t], same / total


def _frequencies(asked: DataFrame, index: Index) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each template word: one row for each word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holding: Counter[bytes] = Counter()
            for piece in pieces([batch]):
                for text in piece["text"].to_pylist():
                    holding.update(index.vocabulary.intersection(words_of(text or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([None, *holding], pa.binary()), pa.array([batch.num_rows, *holding.values()], pa.int64())], ["word", "n"])

    counted = asked.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in counted}
    return found.pop(None, 0), found


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id``, ``n_words``, ``places`` of base phrases and ``notices`` of templates (arrays by start, then label)."""
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    index = Index(templates, phrases)
    index.weigh(*_frequencies(asked, index))
    field = lambda name, kind: T.StructField(name, kind)
    place = [field("start", T.LongType()), field("label", T.StringType())]
    schema = T.StructType([asked.schema["id"], field("n_words", T.LongType()), field("places", T.ArrayType(T.StructType(place))),
                           field("notices", T.ArrayType(T.StructType([*place, field("score", T.DoubleType())])))])
    arrow_place = [("start", pa.int64()), ("label", pa.string())]
    arrow = [pa.int64(), pa.list_(pa.struct(arrow_place)), pa.list_(pa.struct([*arrow_place, ("score", pa.float64())]))]
    phrase_words = frozenset(w for phrase, _ in index.phrases for w in phrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, places, notices = [], [], []
            for text in batch["text"].to_pylist():
                words = words_of(text or b"")
                present = set(words)
                sizes.append(len(words))
                places.append([{"start": s, "label": name} for s, name in index.base(words, present & phrase_words)])
                found = sorted(index.notices(words, present & index.vocabulary))
                notices.append([{"start": s, "label": name, "score": score} for s, name, score in found])
            columns = [pa.array(column, kind) for column, kind in zip((sizes, places, notices), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], schema.names)

    return asked.mapInArrow(run, schema)
