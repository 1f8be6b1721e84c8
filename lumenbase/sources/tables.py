"""JSON Lines, manifests and the vector table."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON Lines; blank lines are none."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest is a few rows: one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def embed_text(retrieval: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(retrieval, F.lit("")), text)


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """The chunk's metadata as flat columns, missing places as empty texts."""
    place = lambda f: F.coalesce(F.col(f"location.{f}").cast("string"), F.lit("")).alias(f)
    return chunks.select(
        "id", embed_text(F.col("retrieval_text"), F.col("text")).alias("document"), "file_id", "source", "relative_path", "file_type", "chunk_index", F.array_join("block_types", ",").alias("block_types"),
        place("section"), place("page"), F.lit("").alias("table"), place("sheet"), place("row"), "char_count",
    )


def hashed_embedding(texts: pd.Series, dim: int = 64) -> pd.Series:
    """A unit vector from hashed words: a stand-in for a trained encoder, the same on every machine. The words of all texts are
    hashed and summed together."""
    words = [" ".join((text or "").lower().split()).encode() for text in texts]
    words = [w.split(b" ") if w else [] for w in words]
    counts = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.int64, counts.sum())
    at = np.repeat(np.arange(len(words)), counts) * dim + h % dim
    v = np.bincount(at, np.where(h & 65536, 1.0, -1.0), len(words) * dim).reshape(-1, dim)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return pd.Series(list((v / np.where(n, n, 1)).astype(np.float32)), index=texts.index, dtype=object)


def embedded(rows: DataFrame, encode: Callable[[pd.Series], pd.Series] = hashed_embedding) -> DataFrame:
    """With `embedding`; encode takes and gives a pandas series, an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return encode(texts)

    return rows.withColumn("embedding", vectors("document"))


def write_vectors(rows: DataFrame, path: str) -> None:
    """Replaces the table. Files are clustered by type, so a search of one kind reads its files alone."""
    rows.write.mode("overwrite").partitionBy("file_type").parquet(path)


def read_vectors(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if file_id is None else rows.where(F.col("file_id") == file_id)
