"""The training-data pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

All but the last return the columns of documents. A document whose doc_id is null has no identity that a decision could
refer to, and goes with the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.llm.common import discard, materialize
from lumenbase.llm.langid import fit_languages, identify
from lumenbase.llm.neardup import near_duplicates
from lumenbase.llm.packing import pack_documents
from lumenbase.llm.substrings import remove_repeats


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    kept = identify(docs, fit_languages(docs)).where(~F.col("rejected")).select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8), the document with the smallest id."""
    kept = near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 20 words or more that also start earlier in the corpus."""
    cleaned = remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", no_repeated_passages),
    ("packing", packed),
]

#: Language identification is a trained model, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. That one has read its documents when it returns, so the stages' tables go then."""
    docs, between = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            between.append(docs)
    discard(*between)
    return docs
