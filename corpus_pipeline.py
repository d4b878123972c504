"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import exact_dedup, mixing, near_dedup, pieces, quality
from lexiloom.llm.queries import TOKENIZERS
from lexiloom.llm.scratch import for_long_rows, materialize, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their language and source."""
    for_long_rows(spark)
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles."""
    for_long_rows(spark)
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more often, as the mixture of sources asks; rows repeat."""
    return mixing.mixed_docs(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids instead of texts."""
    for_long_rows(spark)
    return pieces.encode(docs, pieces.load_table(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", source_mixture),
    ("pieces", piece_ids),
]

#: The near-duplicate, mixing and encoding stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; each but the last is written, as its successor reads it more than once."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
