"""A corpus from raw documents to packed sequences, as stages over Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontam, langid, ngramjoin, packing, pii
from quillstone.llm.common import forget_since, table, tables_so_far, written
from quillstone.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or mostly of scripts that no learned language uses, go."""
    return langid.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts tied by 5-word n-gram similarity of 0.8 or more, the least doc_id stays."""
    return ngramjoin.keep_first(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind in brackets."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", remove_benchmarks),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, tiling and packing are not SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), tables_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_since(mark, docs)  # the tables that led to it
    return docs
