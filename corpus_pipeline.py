"""Corpus pipeline: language identification, exact deduplication, SimHash
near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes what the one before it kept. All but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids and the
digest of the text decoded from the ids. A null doc_id goes through every
stage; empty and null texts are rejected by the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import bpe, decontaminate, exact_dedup, langid, simhash
from loanlens.llm.common import read_table, stored
from loanlens.llm.queries import PATTERN, RANKS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return langid.drop_rejected(docs, langid.learn(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 3-word shingles, 3 bits."""
    return simhash.keep_one(docs, shingle_words=3, radius=3)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that are in a benchmark window."""
    return decontaminate.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    coded = bpe.encode_documents(docs, RANKS, PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the
    shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express compression classes, SimHash components or BPE.
ORACLE_SQL = None
