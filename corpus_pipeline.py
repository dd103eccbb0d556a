"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), applies one operator of
``ledgerline.llm`` to all of ``docs`` and returns what it keeps; between stages
the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import exact, jaccard, langid, mixing, packing
from ledgerline.llm._shared import ready, table
from ledgerline.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS, PERCENT = 5, 80   # near duplicates: word shingles and least similarity
REPEATS = 1.5            # the rarest source is read at most so many times as often as the commonest
END = 1                  # id after each document


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or between two languages go.

    All stay where no language can be learnt (no document has a lang).
    """
    docs = docs.select(COLUMNS)
    return langid.accepted(docs, langid.learn(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact(docs).select(COLUMNS)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs, words=WORDS, percent=PERCENT).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document once at least, those of rare sources more often."""
    return mixing.mix(docs, max_repeats=REPEATS).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: the place of every piece of every document."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END, keep_ids=False)


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(ready(spark), docs, sf_dir)
    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


STAGES = [("language", _stage(clear_language)), ("exact", _stage(distinct_texts)), ("near", _stage(distinct_shingles)),
          ("mix", _stage(mixed_sources)), ("pack", _stage(packed))]

# Language, near copies and tokens can't be told by SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ready(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}-{name}")
    return docs
