"""The cleaning pipeline over documents: toxicity, exact dedup, near-dedup, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and all rows that the one before kept, and is written as Parquet and read
again before the next. All but the last return the columns of docs, whatever these are called besides doc_id and text.

Defined cases, each stage by its operator's rules: null text counts as empty (never toxic by itself, equal to the empty text, of fingerprint
zero, without words, of no tokens); of rows with equal texts that with the largest id stays and of near copies that with the least, a null id only if its group has
no other, and of ties one row; repeated rows are copies of each other; texts of any length are read whole; an empty table stays empty, and
empty labels or benchmark tables reject nothing. Columns named like an operator's outputs pass the first four stages as they are; the last
stage replaces those named n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from platelume.functions.scratch import drop, written
from platelume.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from platelume.llm.common import table


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", clean_speech), ("exact_dedup", one_of_equals), ("near_dedup", one_of_near), ("decontamination", without_benchmark), ("bpe", tokenised)]

#: SQL can express neither the trained classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = written(lambda: stage(spark, before, sf_dir), f"stage-{name}")  # noqa: B023
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir).drop("text")
