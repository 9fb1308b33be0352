"""The corpus pipeline: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as
Parquet in the shared folder and reads again as the next stage's docs; a stage's table goes
when the next one is there. All stages but the last return the columns of ``documents``; each
works on all rows its predecessor kept, repeated rows and null keys included.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, jaccard, mixing, pii, quality
from strandloom.llm.queries import TOKENIZER
from strandloom.runtime import remove, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, once: five-word shingles, similarity 0.8."""
    return jaccard.keep_one(docs, size=5, percent=80, keep_repeats=False)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, pii.fit_pii(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of them and of what they decode to."""
    return bpe.encode_texts(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: Rules ordered by sampling, joins by hashes, fitted trees and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return docs
