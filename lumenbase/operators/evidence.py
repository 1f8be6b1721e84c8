"""Packing of evidence for a prompt, source lists, refusals and service hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.functions.text import location_label, strip, truncated

EVIDENCE_ROWS, PIECE_CHARS, ALL_CHARS, SOURCES = 6, 1250, 10_000, 4
UNKNOWN = "Không rõ"
REFUSAL = "Chưa có đủ căn cứ để trả lời."


def label(df: DataFrame) -> Column:
    """Where a row's text stands, from those of the five location columns that the frame has."""
    parts = [F.col(c) if c in df.columns else F.lit(None) for c in ("section", "page", "table", "sheet", "row")]
    return location_label(*parts)


def evidence_pieces(rows: DataFrame, most: int = EVIDENCE_ROWS) -> DataFrame:
    """question_id, rank, piece: the first rows as the prompt shows them. rows: question_id, rank, source, document."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    text = truncated(strip(F.coalesce("document", F.lit(""))), PIECE_CHARS)
    piece = F.concat(F.lit("[BẰNG CHỨNG "), place.cast("string"), F.lit("]\nNguồn: "), F.coalesce("source", F.lit(UNKNOWN)), F.lit("\nVị trí: "), label(rows), F.lit("\n"), text, F.lit("\n"))
    return rows.select("question_id", place.alias("rank"), piece.alias("piece")).where(F.col("rank") <= most)


def packed(pieces: DataFrame, most: int = ALL_CHARS) -> DataFrame:
    """question_id, pieces, chars, evidence: pieces in order up to the first that would go beyond `most` characters; nothing
    after that one is taken. The joining line breaks don't count. Lengths are not negative, so the running sum tells."""
    order = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = pieces.withColumn("upto", F.sum(F.length("piece")).over(order)).where(F.col("upto") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n")
    return kept.groupBy("question_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("upto").alias("chars"), joined.alias("evidence"))


def source_list(rows: DataFrame, most: int = SOURCES) -> DataFrame:
    """question_id, n, source, location: each pair once, where it first stands, the first `most`."""
    named = rows.select("question_id", "rank", F.coalesce("source", F.lit(UNKNOWN)).alias("source"), label(rows).alias("location"))
    first = named.groupBy("question_id", "source", "location").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    return first.select("question_id", n.alias("n"), "source", "location").where(F.col("n") <= most)


def answers(questions: DataFrame, evidence: DataFrame, answer: Column | None = None) -> DataFrame:
    """question_id, mode, answer: the refusal where there is no evidence; else `answer`, by default the first piece's text,
    which stands in for a language model."""
    told = F.col("evidence") if answer is None else answer
    joined = questions.select("question_id").join(evidence.select("question_id", "pieces", "evidence"), "question_id", "left")
    return joined.select("question_id", F.lit("documents").alias("mode"), F.when(F.coalesce("pieces", F.lit(0)) == 0, F.lit(REFUSAL)).otherwise(told).alias("answer"))


def prompt_messages(system: str, history: Column, question: Column, evidence: Column) -> Column:
    """array<struct<role, content>>: system, history, and the question with its evidence."""
    first = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    last = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Câu hỏi: "), question, F.lit("\n\nBằng chứng:\n"), evidence).alias("content"))
    return F.concat(F.array(first), history, F.array(last))


def valid_question(c: Column, most: int = 2000) -> Column:
    return c.isNotNull() & (F.length(c).between(1, most)) & (strip(c) != "")


def in_service(utc: Column, zone: str = "Asia/Ho_Chi_Minh", opens: int = 7, closes: int = 22) -> Column:
    """Whether a UTC time falls, by the local clock, into [opens, closes)."""
    hour = F.hour(F.from_utc_timestamp(utc.cast("timestamp"), zone))
    return (hour >= opens) & (hour < closes)
