"""Whole batches of questions to answers: routing, timetable messages, evidence, and what a session remembers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.functions.question import engine_of, routed_of
from lumenbase.functions.text import DAY_DISPLAY, SESSION_DISPLAY, format_subject, looked_up, normalize_question
from lumenbase.operators import evidence as E
from lumenbase.operators import timetable as L
from lumenbase.sources.shared import kept

#: What the timetable says where it has no table.
NO_CLASS = "Mình chưa xác định được lớp cần tra thời khóa biểu."
NOTHING_FOUND = "Không tìm thấy dữ liệu thời khóa biểu phù hợp."
TOO_LITTLE = "Mình chưa có đủ thông tin để tra thời khóa biểu."
GROUPED = " [Dữ liệu lấy từ ô nhóm đã gộp trong Excel.]"
DIRECT = ("TKB trực tiếp từ Excel", "Python structured data")


def slot_text(day: Column, session: Column, period: Column) -> Column:
    return F.concat(looked_up(DAY_DISPLAY, day), F.lit(", "), looked_up(SESSION_DISPLAY, session), F.lit(", tiết "), period.cast("string"))


def timetable_messages(lessons: DataFrame, parsed: DataFrame) -> DataFrame:
    """question_id, ok, answer of each question. parsed: question_id, q. Kinds and their order are answer_questions()'s."""
    q = F.col("q")
    rows = kept(L.table_lessons(lessons, parsed), "table-lessons")  # read by three steps
    kinds = L.answer_questions(lessons, parsed, rows).select("question_id", "ok", "type")
    tables = L.tables(rows).select("question_id", "table")
    gaps = L.missing_sessions(rows, parsed)
    first = L.lookup(lessons, parsed).groupBy("question_id").agg(F.min_by(F.struct("value", "ambiguity"), "pos").alias("slot"))
    joined = parsed.join(kinds, "question_id").join(tables, "question_id", "left").join(gaps, "question_id", "left").join(first, "question_id", "left")
    where = slot_text(q["days"][0], q["sessions"][0], q["periods"][0])
    subject = F.concat(F.lit("Lớp "), q["class_name"], F.lit(", "), where, F.lit(": "), format_subject(F.col("slot.value")), F.lit("."), F.when(F.coalesce("slot.ambiguity", F.lit("")) != "", GROUPED).otherwise(""))
    unknown = F.concat(F.lit("Dữ liệu TKB hiện tại không có bản ghi cho lớp "), q["class_name"], F.lit(", "), where, F.lit("."))
    absent = F.array_join(F.transform(F.split("missing", ","), lambda s: F.lower(looked_up(SESSION_DISPLAY, s))), ", ")
    note = F.when(F.coalesce("missing", F.lit("")) != "", F.concat(F.lit("\n\nLưu ý: dữ liệu TKB hiện tại không có tiết "), absent, F.lit(" cho lớp "), F.coalesce(q["class_name"], F.lit("đã chọn")), F.lit("."))).otherwise("")
    kind = F.col("type")
    said = (
        F.when(kind == "class unknown", NO_CLASS).when(kind == "too little known", TOO_LITTLE)
        .when((kind == "lookup") & F.col("ok"), subject).when(kind == "lookup", unknown)
        .when(F.col("ok"), F.concat("table", note)).otherwise(NOTHING_FOUND)
    )
    return joined.select("question_id", "ok", said.alias("answer"))


def answered_by(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """prompts with `reply`: the model runs on the executors and takes a batch of texts at a time."""

    @F.pandas_udf("string")
    def reply(texts: pd.Series) -> pd.Series:
        return model(texts)

    return prompts.withColumn("reply", reply("evidence"))


def answer_batch(questions: DataFrame, lessons: DataFrame, retrieve: Callable[[DataFrame], DataFrame], answer: Column | None = None) -> DataFrame:
    """question_id, mode, answer, sources (array of source and location). questions: question_id, question, and optionally
    context, a struct that a follow-up question inherits; what else they have is for `retrieve`, which gives the evidence of
    the questions that the timetable doesn't answer: question_id, rank, source, document and places. `answer`: a column over
    pieces and evidence; by default the evidence itself stands in for a language model."""
    context = F.col("context") if "context" in questions.columns else None
    norm = F.col("normalised")
    routed = questions.withColumn("normalised", normalize_question(F.col("question"))).withColumn("timetable", routed_of(norm, None if context is None else context.isNotNull()))
    parsed = kept(routed.where("timetable").select("question_id", engine_of(norm, context).alias("q")), "parsed")
    direct = F.array(F.struct(F.lit(DIRECT[0]).alias("source"), F.lit(DIRECT[1]).alias("location")))
    by_table = timetable_messages(lessons, parsed).select("question_id", F.lit("timetable").alias("mode"), "answer", direct.alias("sources"))
    others = routed.where(~F.col("timetable")).drop("timetable", "normalised")
    rows = retrieve(others)
    told = E.answers(others, E.packed(E.evidence_pieces(rows)), answer)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "source", "location"))), lambda x: F.struct(x["source"].alias("source"), x["location"].alias("location")))
    sources = E.source_list(rows).groupBy("question_id").agg(listed.alias("sources"))
    by_text = told.join(sources, "question_id", "left").select("question_id", "mode", "answer", F.coalesce("sources", F.array().cast("array<struct<source:string,location:string>>")).alias("sources"))
    return by_table.unionByName(by_text)


def remembered(asked: DataFrame) -> DataFrame:
    """session_id, pos, role, content: the two messages that an answered question leaves in its session. asked: session_id,
    turn, question, evidence, answer; an empty answer leaves none."""
    said = F.concat(F.lit("CÂU HỎI CỦA HỌC SINH:\n"), "question", F.lit("\n\nBẰNG CHỨNG CỦA LƯỢT HIỆN TẠI:\n"), "evidence")
    two = F.array(F.struct((2 * F.col("turn")).alias("pos"), F.lit("user").alias("role"), said.alias("content")), F.struct((2 * F.col("turn") + 1).alias("pos"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return asked.where(F.coalesce("answer", F.lit("")) != "").select("session_id", F.inline(two))
