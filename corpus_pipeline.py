"""Corpus pipeline: quality, exact and near duplicates, source mixing, encoding; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm import exact_dedup, mixing, near_dedup, quality, queries, subword
from dealgrid.llm.common import land, table

#: Runs of words that near duplicates share, and the similarity from which they are linked.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ranker, fitted on the labelled ones among them, accepts."""
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), quality.training_rows(F.col("doc_id")))
    return quality.keep_good(docs, ranker)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs, NEAR_WORDS, NEAR_SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its draw say, in a seeded order."""
    copies = mixing.replicate(docs, queries.SOURCE_WEIGHTS, epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)
    return copies.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's piece ids: doc_id, replica, n_pieces, pieces, and a digest of what they decode to; copies are cut apart from each other and keep a seeded order."""
    return subword.encode(mixing.numbered(docs, queries.MIX_SEED), replica="replica")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The ranker, the sketches and the merges have no SQL form; the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
