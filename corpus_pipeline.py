"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents;
the last returns the packed pieces. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm import langid, line_dedup, packing, quality, simhash
from commitscope.llm._common import finished, load


def _columns(docs: DataFrame) -> list[str]:
    return docs.columns


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; learned from the stage's own rows that are not held out."""
    return langid.keep_identified(docs).select(_columns(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the isolation forest finds anomalous go."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels")).select(_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    kept = out.filter(~F.col(out.columns[-1]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col(out.columns[-2]) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(_columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id."""
    return simhash.near_dedup(docs).select(_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row")


STAGES = [("language", language), ("quality", rules), ("lines", lines), ("near", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None
