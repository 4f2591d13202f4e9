"""From raw documents to token ids: language, copies, near copies, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailsift.llm import byte_bpe, exact_dedup, language_id, mixing, order_minhash
from trailsift.llm.common import stored, table
from trailsift.llm.queries import KEPT, RANK_FILE, TARGETS, labelled_domains
from trailsift.session import tune

# Below an even draw between three languages a text is in none of those learned.
LEAST_SCORE = 0.3


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that was learned, go."""
    tune(spark)
    return language_id.known_language(docs, LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points stays, then the least id."""
    tune(spark)
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least id stays."""
    tune(spark)
    return order_minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains of the label table get their target shares, as far as there is enough of those that are not kept; no document is taken more than once."""
    tune(spark)
    return mixing.mix(docs, labelled_domains(table(spark, sf_dir, "labels")), TARGETS, kept=KEPT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    tune(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", in_known_language),
    ("exact_dedup", without_copies),
    ("order_minhash", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]

# Language ID, order MinHash and the fitted rates have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back as the documents of the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
