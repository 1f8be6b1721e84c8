"""Integrity checks: duplicate content, counts, needles, numeric-only chunks, guards, and the catalogue of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.functions.text import catalogue_id, looked_up, numeric_only

TYPE_LABELS = {".pdf": "PDF", ".docx": "Word", ".xlsx": "Excel", ".xlsm": "Excel"}


def duplicate_groups(files: DataFrame, key: Column) -> DataFrame:
    """content_sha1, n, first_id: contents that several files have."""
    digest = F.sha1(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return files.groupBy(digest.alias("content_sha1")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def counts(blocks: DataFrame) -> DataFrame:
    """file_type, block_type, n: both groupings, and all, in one pass; a column that a row doesn't group by is 'all'."""
    grouped = blocks.groupingSets([["file_type"], ["block_type"], []], "file_type", "block_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.coalesce("file_type", F.lit("all")).alias("file_type"), F.coalesce("block_type", F.lit("all")).alias("block_type"), "n")


def needles(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """needle, n: in how many texts each stands, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("needle"), F.col("text").contains(w).cast("long").alias("hit")) for w in wanted]))
    return texts.select(each.alias("e")).groupBy(F.col("e.needle").alias("needle")).agg(F.sum(F.coalesce("e.hit", F.lit(0))).alias("n"))


def numeric_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(numeric_only(F.col("text")))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, if it has a row; an error names what is missing."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def catalogue(paths: DataFrame) -> DataFrame:
    """The catalogue of supported files. paths: relative_path, size_bytes. Temporary files are listed too."""
    path = F.trim(F.replace("relative_path", F.lit("\\"), F.lit("/")), F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    kind = looked_up(TYPE_LABELS, suffix)
    first = paths.withColumn("path", path).where((F.col("path") != "") & kind.isNotNull()).groupBy("path").agg(F.min("size_bytes").alias("size_bytes"))
    named = first.select(catalogue_id(F.col("path")).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("relative_path"), "size_bytes")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    group = F.when(suffix.isin(".xlsx", ".xlsm"), F.lit("Thời khóa biểu")).otherwise(F.lit("Tài liệu nhà trường"))
    return named.select("id", "name", "relative_path", looked_up(TYPE_LABELS, suffix).alias("type"), F.concat(F.lit("/api/documents/"), "id", F.lit("/download")).alias("download_url"), "size_bytes", group.alias("source_group"))


def catalogue_search(items: DataFrame, words: str) -> DataFrame:
    """Items whose name, type and group, in lower case, contain the words."""
    return items.where(F.lower(F.concat_ws(" ", "name", "type", "source_group")).contains(words.strip().lower()))


def catalogue_item(items: DataFrame, item_id: str) -> DataFrame:
    """The item with this id; an id that is no sixteen hexadecimal digits is refused."""
    if len(item_id) != 16 or set(item_id) - set("0123456789abcdef"):
        raise ValueError("not a document id")
    return items.where(F.col("id") == item_id)
