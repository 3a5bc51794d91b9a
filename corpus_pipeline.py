"""A corpus from documents to packed token sequences, in five stages that each call an operator of ``effectum.llm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectum.llm import langid, line_dedup, packing, pii, simhash
from effectum.llm.common import materialise
from effectum.llm.queries import tokenizer


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text."""
    length: Column = F.char_length("text").cast("long")
    return changed.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, and those between two languages, go."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate in their source."""
    return _like(docs, line_dedup.drop_site_lines(docs, F.col("source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: five-word shingles, a similarity of 0.8 or more. Fingerprints within two bits are searched first, then exactly what they leave."""
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8, radius=2)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for private entities."""
    return _like(docs, pii.with_surrogates(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0, capacity=1024, memo=120_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
