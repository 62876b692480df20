"""The corpus pipeline: each stage keeps what the next one works on.

A stage takes the session, the documents that its predecessor kept and the folder of the
tables. All stages but the last return the columns of documents; the last returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadloom.durable import Rounds
from roadloom.llm import bpe, decontamination, line_quality, near_duplicates, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be good."""
    return line_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", _toxicity),
    ("quality classifier", _quality),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontamination),
    ("BPE encoding and decoding", _tokens),
]

#: SQL can't express the classifiers, so the pipeline is tested against a plain model of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each but the last is stored and read again."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), Rounds(spark, "kept-documents")
    for _, stage in STAGES[:-1]:
        docs, _ = stored.save(stage(spark, docs, sf_dir))
    stored.drop_superseded()
    return STAGES[-1][1](spark, docs, sf_dir)
