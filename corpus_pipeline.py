"""From raw documents to packed training sequences: five stages, each one operator of `demandloom.llm`.

Every stage takes all that the one before it kept, written as Parquet in the shared folder and read
again, and returns the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from demandloom.llm.contamination import decontaminate
from demandloom.llm.frames import read_table, staged
from demandloom.llm.host_rules import keep_good
from demandloom.llm.jaccard import drop_near_copies
from demandloom.llm.line_chunks import dedup_lines
from demandloom.llm.queries import packed_digests

#: Near copies share four fifths of their five-word shingles.
WIDTH, THRESHOLD = 5, Fraction(4, 5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source is not rejected."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those with nothing left go."""
    return dedup_lines(docs, drop_emptied=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs, width=WIDTH, threshold=THRESHOLD)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 1024 ids."""
    return packed_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Rolling hashes, token orders and a tokenizer are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
