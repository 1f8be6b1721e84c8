"""Questions against lesson facts: filters, exact lookups, answers, tables, and searches over chunk texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.functions.question import with_parsed
from lumenbase.functions.text import (
    CLASS_NAME,
    DAY_DISPLAY,
    SESSION_DISPLAY,
    format_subject,
    grade_of_class,
    header_value,
    looked_up,
    names_class,
    names_grade,
    period_lines,
)
from lumenbase.operators.intervals import positions
from lumenbase.operators.search import KEY, STRUCTURED, by_batches

DEDUPE = ["source", "sheet", "class_name", "day", "session", "period", "value"]
CLASS_LINE = rf"(?imU)^\s*({CLASS_NAME})\s*:"
TABLE_HEAD = "| Lớp | Thứ | Buổi | Tiết | Môn học |\n|---|---|---|---:|---|"


def lesson_order() -> list[Column]:
    return [F.col("day").cast("int"), F.when(F.col("session") == "S", 0).otherwise(1), F.col("period"), F.col("class_name"), F.col("pos")]


def load_order(lessons: DataFrame) -> DataFrame:
    """With `position`: where a lesson stands in the order in which a timetable is loaded, class first."""
    return positions(lessons, "class_name", F.col("day").cast("int"), F.when(F.col("session") == "S", 0).otherwise(1), "period", "source", "pos")


def deduped(lessons: DataFrame, *by: str) -> DataFrame:
    """The first, by pos, of lessons that agree in DEDUPE (and `by`)."""
    first = Window.partitionBy(*by, *DEDUPE).orderBy("pos")
    return lessons.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def none_or(wanted: Column, condition: Column) -> Column:
    """An empty list asks for nothing in particular."""
    return (F.size(wanted) == 0) | condition


def on_class_or_grade(rows: DataFrame, asked: DataFrame, rest: Column, classes: str = "class_name", grades: str = "grade") -> DataFrame:
    """rows and the predicates q of a batch of questions that admit them: by an equi-join on the class that a question names,
    else on its grade; questions with neither meet all rows, for `rest` alone decides. classes, grades: the columns of rows."""
    q = F.col("q")
    by_class = asked.where(q["class_name"].isNotNull()).withColumn("key", q["class_name"])
    by_grade = asked.where(q["class_name"].isNull() & q["grade"].isNotNull()).withColumn("key", q["grade"])
    others = asked.where(q["class_name"].isNull() & q["grade"].isNull())
    parts = [rows.join(F.broadcast(a), F.col(c) == F.col("key")).drop("key") for a, c in ((by_class, classes), (by_grade, grades))]
    return parts[0].unionByName(parts[1]).where(rest).unionByName(rows.join(F.broadcast(others), rest))


def candidates(lessons: DataFrame, parsed: DataFrame) -> DataFrame:
    """question_id and the lessons that its predicate q admits: the class, or else the grade, and each list that is not
    empty. The batch of questions is the small side."""
    q = F.col("q")
    rest = (
        none_or(q["days"], F.array_contains(q["days"], F.col("day")))
        & none_or(q["sessions"], F.array_contains(q["sessions"], F.col("session")))
        & none_or(q["periods"], F.array_contains(q["periods"], F.col("period")))
    )
    return by_batches(parsed.select("question_id", "q"), lambda asked: on_class_or_grade(lessons, asked, rest))


def single(q: Column) -> Column:
    """Whether a predicate names one lesson slot."""
    return q["class_name"].isNotNull() & (F.size(q["days"]) == 1) & (F.size(q["sessions"]) == 1) & (F.size(q["periods"]) == 1)


def lookup(lessons: DataFrame, parsed: DataFrame) -> DataFrame:
    """Lessons of the slots that questions name, by an equi-join on the four keys."""
    q = F.col("q")
    keys = parsed.where(single(q)).select("question_id", q["class_name"].alias("class_name"), q["days"][0].alias("day"), q["sessions"][0].alias("session"), q["periods"][0].alias("period"))
    return deduped(by_batches(keys, lambda asked: lessons.join(asked, ["class_name", "day", "session", "period"])), "question_id")


def table_line() -> Column:
    day = F.coalesce(looked_up(DAY_DISPLAY, F.col("day")), F.col("day"))
    session = F.coalesce(looked_up(SESSION_DISPLAY, F.col("session")), F.col("session"))
    star = F.when(F.coalesce("ambiguity", F.lit("")) != "", F.lit("*")).otherwise(F.lit(""))
    return F.concat(F.lit("| "), F.concat_ws(" | ", "class_name", day, session, F.col("period").cast("string"), F.concat(format_subject(F.col("value")), star)), F.lit(" |"))


def tables(found: DataFrame) -> DataFrame:
    """question_id, n_rows, table: a question's lessons in order, as a table in Markdown."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(lesson_order())], table_line().alias("line"))))
    return found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("\n", F.lit(TABLE_HEAD), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("table"))


def missing_sessions(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """question_id, missing: sessions asked for, of several, that no lesson has."""
    got = found.groupBy("question_id").agg(F.collect_set("session").alias("got"))
    asked = parsed.where(F.size("q.sessions") > 1).select("question_id", F.col("q.sessions").alias("sessions"))
    return asked.join(got, "question_id", "left").select("question_id", F.array_join(F.array_except("sessions", F.coalesce("got", F.array().cast("array<string>"))), ",").alias("missing"))


def parsed_questions(questions: DataFrame) -> DataFrame:
    """question_id, question, q."""
    return with_parsed(questions)


def table_lessons(lessons: DataFrame, parsed: DataFrame) -> DataFrame:
    """The lessons of each question's table, once each; questions without class and grade get none."""
    return deduped(candidates(lessons, parsed.where("q.class_name is not null or q.grade is not null")), "question_id")


def answer_questions(lessons: DataFrame, parsed: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """question_id, ok, type, n_rows, first_value. In this order: a table without class or grade fails; a single slot is
    looked up; a table mode gives the table; class, day, session and period together give a table; else too little is
    known."""
    found = table_lessons(lessons, parsed) if found is None else found
    rows = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("table_rows"))
    slots = lookup(lessons, parsed).groupBy("question_id").agg(F.count(F.lit(1)).alias("slot_rows"), F.min_by("value", "pos").alias("slot_value"))
    q = F.col("q")
    joined = parsed.join(rows, "question_id", "left").join(slots, "question_id", "left").withColumn("t", F.coalesce("table_rows", F.lit(0))).withColumn("s", F.coalesce("slot_rows", F.lit(0)))
    unnamed = (q["mode"] == "timetable") & q["class_name"].isNull() & q["grade"].isNull()
    full = q["class_name"].isNotNull() & (F.size(q["days"]) > 0) & (F.size(q["sessions"]) > 0) & (F.size(q["periods"]) > 0)
    kind = F.when(unnamed, F.lit("class unknown")).when(single(q), F.lit("lookup")).when((q["mode"] == "timetable") | full, F.lit("table")).otherwise(F.lit("too little known"))
    n = F.when(kind == "lookup", F.col("s")).when(kind == "table", F.col("t")).otherwise(F.lit(0))
    return joined.select("question_id", (n > 0).alias("ok"), kind.alias("type"), n.alias("n_rows"), F.when(kind == "lookup", F.col("slot_value")).alias("first_value"))


def lesson_records(lessons: DataFrame) -> DataFrame:
    """Lessons as they are shown."""
    return lessons.select(
        "class_name", "day", F.coalesce(looked_up(DAY_DISPLAY, F.col("day")), "day").alias("day_name"), "session",
        F.coalesce(looked_up(SESSION_DISPLAY, F.col("session")), "session").alias("session_name"), "period", format_subject(F.col("value")).alias("subject"), "value", "source", "sheet",
    )


def structured_v1(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, KEY, structured_score, rank over texts with a line for each of day, session, period and class."""
    parsed = with_parsed(questions, "chunk_v1").select("question_id", "q")
    q = F.col("q")
    said = q["class_name"].isNotNull() | q["grade"].isNotNull() | q["day"].isNotNull() | q["session"].isNotNull() | (F.size(q["periods"]) > 0)
    doc = F.col("document")
    rows = chunks.where(F.col("file_type").isin(*STRUCTURED)).withColumns({"d": header_value(doc, "Thứ"), "s": header_value(doc, "Buổi"), "p": header_value(doc, "Tiết")})
    rest = (
        F.coalesce(F.col("d") == q["day"], q["day"].isNull())
        & F.coalesce(F.col("s") == q["session"], q["session"].isNull())
        & none_or(q["periods"], F.coalesce(F.array_contains(q["periods"], F.col("p")), F.lit(False)))
        & F.coalesce(names_class(doc, q["class_name"]), F.lit(True))
        & F.coalesce(names_grade(doc, q["grade"]), F.lit(True))
    )
    named = F.transform(F.regexp_extract_all(doc, F.lit(CLASS_LINE), F.lit(1)), F.upper)
    score = F.when(q["class_name"].isNotNull(), 4).otherwise(0) + F.when(q["grade"].isNotNull(), 2).otherwise(0) + F.when(q["day"].isNotNull(), 2).otherwise(0) + F.when(q["session"].isNotNull(), 2).otherwise(0) + F.when(F.size(q["periods"]) > 0, 2).otherwise(0)

    def fitting(asked: DataFrame) -> DataFrame:
        """Each class that has a line, and each grade of one, is a row; a question with neither looks at the chunk once."""
        plain = rows.select(*KEY, "document", "d", "s", "p", named.alias("names"))
        grades = F.array_distinct(F.transform("names", grade_of_class))
        with_class, with_grade = asked.where(q["class_name"].isNotNull()), asked.where(q["class_name"].isNull() & q["grade"].isNotNull())
        parts = [
            plain.withColumn("key", F.explode(F.array_distinct("names"))).join(F.broadcast(with_class), F.col("key") == q["class_name"]).drop("key"),
            plain.withColumn("key", F.explode(grades)).join(F.broadcast(with_grade), F.col("key") == q["grade"]).drop("key"),
        ]
        return parts[0].unionByName(parts[1]).where(rest).unionByName(plain.join(F.broadcast(asked.where(q["class_name"].isNull() & q["grade"].isNull())), rest))

    found = by_batches(parsed.where(said), fitting).withColumn("structured_score", score)
    order = Window.partitionBy("question_id").orderBy(F.desc("structured_score"), F.coalesce(F.col("p").try_cast("int"), F.lit(0)), *KEY)
    return found.select("question_id", *KEY, "structured_score", F.row_number().over(order).alias("rank"))


def structured_v4(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, KEY, structured_score, rank, rrf_score over texts of one class, day and session with a line a period.
    The order is that of the timetable, whatever the score."""
    parsed = with_parsed(questions, "chunk_v4").select("question_id", "q")
    q, doc = F.col("q"), F.col("document")
    said = q["class_name"].isNotNull() | q["grade"].isNotNull() | (F.size(q["days"]) > 0) | q["session"].isNotNull() | (F.size(q["periods"]) > 0)
    text = {f: F.coalesce(header_value(doc, n), F.lit("")) for f, n in (("cls", "Lớp"), ("grade", "Khối"), ("day", "Thứ"), ("ses", "Buổi"))}
    named = F.upper(text["cls"])
    grade = F.coalesce(F.nullif(F.regexp_extract(text["grade"], "[0-9]+", 0), F.lit("")), grade_of_class(named))
    session = F.when(text["ses"].rlike(r"(?iU)sáng|\(s\)"), F.lit("S")).when(text["ses"].rlike(r"(?iU)chiều|\(c\)"), F.lit("C")).otherwise(F.lit(""))
    rows = chunks.where(F.col("file_type").isin(*STRUCTURED)).withColumns({"cls": named, "grd": grade, "d": F.regexp_extract(text["day"], r"\(([2-7])\)", 1), "s": session, "ps": period_lines(doc)})
    meets = F.arrays_overlap(q["periods"], F.col("ps"))
    rest = F.coalesce(F.col("grd") == q["grade"], F.lit(True)) & none_or(q["days"], F.array_contains(q["days"], F.col("d"))) & F.coalesce(F.col("s") == q["session"], F.lit(True)) & none_or(q["periods"], meets)
    score = F.when(q["class_name"].isNotNull(), 6).otherwise(0) + F.when(q["grade"].isNotNull(), 3).otherwise(0) + F.when(F.size(q["days"]) > 0, 3).otherwise(0) + F.when(q["session"].isNotNull(), 3).otherwise(0) + F.when(F.size(q["periods"]) > 0, 2).otherwise(0)
    found = by_batches(parsed.where(said), lambda asked: on_class_or_grade(rows, asked, rest, "cls", "grd")).withColumn("structured_score", score)
    order = Window.partitionBy("question_id").orderBy(F.coalesce(F.col("d").try_cast("int"), F.lit(99)), F.when(F.col("s") == "S", 0).otherwise(1), "cls", "chunk_index", "file_id")
    rank = F.row_number().over(order)
    return found.select("question_id", *KEY, "structured_score", rank.alias("rank")).withColumn("rrf_score", F.round(1 / (60 + F.col("rank")), 6))
