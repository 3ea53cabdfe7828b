"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet under the session's shared checkpoint folder and read again as the
next stage's documents. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tremor.llm import decontaminate, exact_dedup, packing, quality, simhash
from tremor.llm.common import read_table, scratch, stored

END_ID = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(spark, docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.deduplicate(spark, docs, width=4, max_bits=4)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an exact occurrence of a benchmark window go."""
    return decontaminate.remove_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(spark, docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("packing", packing_stage),
]
# Hashes, a trained model and a tokenizer are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
