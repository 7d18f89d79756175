"""The corpus pipeline: STAGES in order over documents, each written as Parquet and read again.

Stages but the last return documents' own columns. A stage's docstring says
what happens to odd rows; see the operators for the rest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import byte_bpe, line_dedup, mixing, ngram_join, quality
from tallgrass.llm.common import release, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule (null and short texts among them) or the log-likelihood ratio go."""
    return quality.clean(docs, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents of which nothing is left; n_chars follows."""
    return line_dedup.deduplicated(docs, gram=5, percent=80)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays, that of the smallest doc_id; texts without words are linked with nothing."""
    return ngram_join.representatives(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.apply_mix(docs, weights=(5, 2, 1), share=1.5, repeats=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with digests of them and of the text that they decode to; a null text has no ids."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", remove_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("weighted_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Hashes that SQL engines don't share decide the mix and the scores; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, before, sf_dir), name)
        if hasattr(before, "stored_at"):
            release(before)
        before = docs
    return docs
