"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``, whatever their names, and other columns that come with them.

A null or empty text fails the first stage's base rule of 20 words. A null id, language or source is a value like others, and
rows that repeat are judged each: the second stage leaves one of them. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm import mixing, near_duplicates, pieces, pii, quality_rules
from landweave.llm.common import discard, keep, scope, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the log-likelihood ratio rejects go."""
    return quality_rules.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id; texts without words all stay.

    It goes by texts: different texts under one id both stay, and rows without an id are judged like others.
    """
    return near_duplicates.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources weigh the same, in one global shuffle."""
    return mixing.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, as piece ids."""
    return pieces.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Hashed likelihood ratios, MinHash and sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a stage writes on its way go when it is done, its result when the next one has read it."""
    docs, last = table(spark, sf_dir, "documents"), len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES[:last]):
        with scope(spark):
            done = keep(written(stage(spark, docs, sf_dir), f"stage{k}"))
        if k:
            discard(docs)
        docs = done
    return STAGES[last][1](spark, docs, sf_dir)
