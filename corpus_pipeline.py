"""A corpus pipeline of four stages: toxicity, exact deduplication, near-duplicate join, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import written
from metricloom.llm.exact_dedup import drop_copies
from metricloom.llm.ngram_join import one_of_each
from metricloom.llm.packing import pack_tokens
from metricloom.llm.toxicity import without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on `labels`, predicts to be toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of texts that are equal but for the case of A-Z the row with the largest doc_id."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of documents that links of similar shingle sets join the one with the smallest doc_id."""
    return one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A batch and a slot in it for every document, by its number of tokens."""
    return pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("packing", packing_stage)]

#: The toxicity stage is a trained model, which SQL cannot express; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
