"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import annsearch, htmlx, linededup, mixing, ngramjoin, packing, substring, toxicity, vecjoin, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    """The production tokenizer, by the paths of its two formats."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"), revisit_from=0)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlx.extract(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=2048, **tokenizer_files())


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecjoin.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return annsearch.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_classes(_table(spark, sf_dir, "documents"))
    named = lambda c: F.when(F.col(c) != ngramjoin.NO_ID, F.col(c))
    return found.select(named("doc").alias("doc_id"), F.col("line").alias("line_no"), named("first_doc").alias("kept_doc_id"), F.col("first_line").alias("kept_line_no"), "kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op4_near_vectors": vecjoin.SQL, "op8_mixing": mixing.SQL}
