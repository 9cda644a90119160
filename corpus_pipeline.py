"""A corpus pipeline over `documents`: language, exact and near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of docs; the last adds token ids.
Each stage's result is written as Parquet and reread, so a lost executor costs no more than the stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import common, decontaminate, exact, language, pieces, shingles


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and resembles a language of the labelled documents; lang is predicted where it is null."""
    return language.recognised(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts, the document with the smallest doc_id."""
    return exact.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles with a similarity of 0.8 or more, the document with the smallest doc_id.

    Candidates come from the covering tables of SimHash fingerprints and, beyond their radius, from MinHash bands.
    """
    return shingles.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of 13 words, and with less than a twentieth of their words in shorter items."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return pieces.round_trip(docs).select("doc_id", "ids", "n_pieces", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither the hyperdimensional profiles nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.stash(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return docs
