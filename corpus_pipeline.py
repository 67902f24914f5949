"""A corpus pipeline over ``documents``: toxicity, fuzzy lines, near copies, source mixing, packing.

Each stage takes what the one before it kept and returns documents again; the last returns packed pieces. Parameters are
the production ones: near copies share 80 % of their shingles of five words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import linededup, mixing, ngramjoin, packing, toxicity
from ledgerloom.llm.queries import tokenizer_files
from ledgerloom.plans.runtime import drop, stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another document or an earlier line has already."""
    return linededup.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id; documents without text stay."""
    return ngramjoin.keep_one(docs, width=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, capacity=2048, **tokenizer_files())


STAGES = [
    ("toxicity", clean),
    ("line_dedup", distinct_lines),
    ("ngram_join", distinct_documents),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fuzzy lines and near copies by signatures, and a trained classifier, are beyond SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        then = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            then = stage(then, name)
        if k:
            drop(*([docs] if k + 1 < len(STAGES) else []))
        docs = then
    return docs
