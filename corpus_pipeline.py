"""The training-corpus pipeline: quality rules, one document of each near-duplicate group, masked personal data, mixed sources, packed sequences.

A stage's result is written before the next stage begins, which then deletes the work tables that the result was read from.

Defined results: null texts fail the quality rules; rows with a null or repeated id are documents of their own until
the Jaccard stage, which keeps one of each group; a null lang or source is one of the name ""; columns that documents
has besides its own go through all stages but the last; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import jaccard, mixing, packing, pii, quality
from termloom.llm.common import discard, scope, stored
from termloom.llm.queries import tokenizer_path

#: Work tables of the stage that ran last.
_LEFT: list[DataFrame] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_LEFT)
        _LEFT.clear()
        with scope() as own:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(own)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and threshold rules reject go."""
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the smallest id of each group stays."""
    return jaccard.keep_first(docs, ngram=5, percent=80)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are masked."""
    return pii.mask(docs)


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per epoch that the mixture gives them."""
    return mixing.mix(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mixed_sources), ("packing", packed_sequences)]

#: SQL has neither the tokenizer nor the conditional random field; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
