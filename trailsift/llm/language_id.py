"""Language ID: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are as alike as the share of 1- to 3-grams of letters that both have: k(x, y) = |x and y| / sqrt(|x| |y|).  A bounded sample
of labelled texts of every language is fitted (``PER_LANGUAGE`` texts of each, fewer if that makes more than ``TEXTS``; ``LANDMARKS`` of
them landmarks, or a few of each language); only their packed presence rows reach the driver.  Every text is then scored in batches: presence rows times landmarks times weights, two matrix products, no shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned.  Rows with a
null id or a null language are predicted but never learned from.  Letters are those of Unicode in all planes, so emoji are none.  Repeated
rows each get the same result; a very long text is read whole, as one row of one task; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import pieces, positional
from trailsift.llm.grams import DIMS, presence

LENGTHS = (1, 2, 3)
PER_LANGUAGE = 300  # bound of the texts learned from, for each language
TEXTS = 20_000  # bound of all texts learned from; with many languages each gets fewer
LANDMARKS = 128  # in all, or LANDMARKS_EACH for each language where that is more
LANDMARKS_EACH = 4
RIDGE = 1e-3
SHARPNESS = 4.0  # of the softmax that turns margins into a score
OVER_EVEN = 1.2
UNKNOWN = "und"
HELD_OUT_PARTS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_PARTS == 0, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    landmarks: bytes  # packed presence rows
    weights: np.ndarray  # landmarks x languages


def _unpacked(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, DIMS // 8), axis=1)


def kernel(rows: np.ndarray, columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.maximum(rows.sum(1, dtype=np.int64), 1)
    return (rows.astype(np.float32) @ columns) / np.sqrt(own[:, None] * np.maximum(sizes, 1)[None, :])


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = np.packbits(presence([t or "" for t in batch["text"].to_pylist()], LENGTHS, True), axis=1)
        yield pa.RecordBatch.from_arrays([batch["draw"], batch["lang"], pa.array([r.tobytes() for r in rows], pa.binary())], ["draw", "lang", "grams"])


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, bytes]]:
    """Packed presence rows of a bounded, spread sample of the documents that may be learned from."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("string")) % HELD_OUT_PARTS != 0)
    )
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return []
    per_language = max(LANDMARKS_EACH, min(per_language, TEXTS // len(counts)))
    # Each language is thinned at a rate of its own; twice the bound is drawn, and the rest cut off after.
    rates = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], 2.0 * per_language / r["count"]) for r in counts], "lang string, rate double"))
    draw = F.pmod(F.xxhash64("id", F.lit("learn")), F.lit(2**40)) / F.lit(float(2**40))
    drawn = usable.withColumn("draw", draw).join(rates, "lang").filter(F.col("draw") < F.col("rate")).filter(F.col("text").rlike(r"\p{L}"))
    packed = drawn.select("draw", "lang", "text").mapInArrow(_packed_rows, "draw double, lang string, grams binary")
    rows = packed.orderBy("draw", "lang", "grams").limit(2 * per_language * len(counts)).collect()
    taken: dict[str, int] = {}
    kept = []
    for r in rows:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            kept.append((r.lang, bytes(r.grams)))
    return kept


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Nyström features from the landmarks, then a ridge regression of +1 / -1 for each language."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    by_language = [[g for lang, g in rows if lang == name] for name in languages]
    each = max(LANDMARKS_EACH, landmarks // len(languages))
    marks = b"".join(g for own in by_language for g in own[:each])
    target = np.array([languages.index(lang) for lang, _ in rows])
    texts, chosen = _unpacked(b"".join(g for _, g in rows)), _unpacked(marks)
    columns, sizes = chosen.T.astype(np.float32), chosen.sum(1, dtype=np.int64)
    values, vectors = np.linalg.eigh(kernel(chosen, columns, sizes).astype(np.float64))
    sound = values > 1e-6 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])
    features = kernel(texts, columns, sizes) @ root
    # Every language weighs the same, however many texts it has.
    weight = 1.0 / np.bincount(target)[target]
    signs = np.where(target[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (signs * weight[:, None]))
    return Model(languages, marks, root @ solved)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` by position (the text may be left out) plus ``lang_pred`` and ``score``."""
    at = docs.columns.index(text_col)
    held = [k for k in range(len(docs.columns)) if keep_text or k != at]
    renamed = positional(docs)
    schema = T.StructType([*(renamed.schema[k] for k in held), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if model is None else _unpacked(model.landmarks).astype(np.float32).T.copy()
        for batch in pieces(batches):
            rows = presence([t or "" for t in batch.column(at).to_pylist()], LENGTHS, True)
            found, score = np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
            if model is not None and len(rows):
                margins = kernel(rows, marks, marks.sum(0)) @ model.weights
                share = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                has = rows.any(axis=1)
                found[has] = np.array(model.languages, object)[share.argmax(1)[has]]
                score[has] = share.max(1)[has]
            columns = [*(batch.column(k) for k in held), pa.array(list(found), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return renamed.mapInArrow(label, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from ``docs``, then predict only from the texts: ``id``, ``held_out``, ``lang_pred``, ``score``."""
    model = fit(training_rows(docs, id_col, text_col, lang_col, per_language))
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return predict(asked, model, keep_text=False).toDF("id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language is recognised, with all their columns.

    The score must reach ``least``, or ``OVER_EVEN`` times an even draw among the languages learned where that is lower.  If nothing could
    be learned no language can be told from another, and all documents pass through unchanged.
    """
    model = fit(training_rows(docs, id_col, text_col, lang_col, PER_LANGUAGE))
    if model is None:
        return docs
    bound = min(least, OVER_EVEN / len(model.languages))
    named = predict(docs, model, text_col).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= bound))
    return named.drop("lang_pred", "score").toDF(*docs.columns)
