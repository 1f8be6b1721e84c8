"""Matrix timetables to facts: header detection, un-pivot, forward fill, merged ranges, records by class and session.

Input is a long table of cells (source, relative_path, sheet, row, col, value) and one of merged ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.functions.text import (
    EMPTY_SLOT,
    cell_line,
    clean_cell,
    day_code,
    format_subject,
    grade_of_class,
    is_class_name,
    number_key,
    period_key,
    sessions_in,
    sheet_day,
    sheet_day_display,
    sheet_session,
    sheet_session_display,
)
from lumenbase.operators.intervals import points_in_ranges

SHEET = ["source", "sheet"]
HEADER_WORDS = ("Thứ", "Buổi", "Tiết")


def header_rows(cells: DataFrame, dialect: str = "engine") -> DataFrame:
    """SHEET, header_row: `engine` wants all three header words within 15 rows; `chunk` any of them in a row of at least
    three filled cells within ten."""
    text = clean_cell(F.col("value")) if dialect == "engine" else cell_line(F.col("value"))
    filled = cells.where(F.col("row") <= (15 if dialect == "engine" else 10)).withColumn("text", text).where("text <> ''")
    rows = filled.groupBy(*SHEET, "row").agg(F.collect_set(F.when(F.col("text").isin(*HEADER_WORDS), F.col("text"))).alias("words"), F.count(F.lit(1)).alias("n"))
    good = F.size("words") == 3 if dialect == "engine" else (F.size("words") > 0) & (F.col("n") >= 3)
    return rows.where(good).groupBy(*SHEET).agg(F.min("row").alias("header_row"))


def sheet_titles(cells: DataFrame, rows: int = 3) -> DataFrame:
    """SHEET, title: the first filled cell of the first rows."""
    text = clean_cell(F.col("value"))
    top = cells.where((F.col("row") <= rows) & (F.coalesce("value", F.lit("")) != ""))
    return top.groupBy(*SHEET).agg(F.min_by(text, F.struct("row", "col")).alias("title"))


def class_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """SHEET, col, class_name."""
    name = F.upper(clean_cell(F.col("value")))
    return cells.join(headers, SHEET).where(F.col("row") == F.col("header_row")).select(*SHEET, "col", name.alias("class_name")).where(is_class_name(F.col("class_name")))


def row_context(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """SHEET, row, day, session, period_text: day and session filled down from the last row that named one."""
    text = clean_cell(F.col("value"))
    at = {c: F.max(F.when(F.col("col") == c, text)) for c in (1, 2, 3)}
    rows = cells.join(headers, SHEET).where(F.col("row") > F.col("header_row")).groupBy(*SHEET, "row").agg(at[1].alias("c1"), at[2].alias("c2"), F.coalesce(at[3], F.lit("")).alias("period_text"))
    down = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*SHEET, "row", F.last(day_code(F.col("c1")), True).over(down).alias("day"), F.last(F.get(sessions_in(F.col("c2")), F.lit(0)), True).over(down).alias("session"), "period_text")


def processed_ranges(cells: DataFrame, merged: DataFrame, headers: DataFrame, classes: DataFrame) -> DataFrame:
    """Ranges below the header that cover a class column and whose anchor holds text: the range, n_classes, value."""
    text = clean_cell(F.col("value"))
    anchors = cells.select(*SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"), text.alias("value")).where("value <> ''")
    below = merged.join(headers, SHEET).where(F.col("max_row") > F.col("header_row")).join(anchors, [*SHEET, "min_row", "min_col"])
    joined = points_in_ranges(classes.select(*SHEET, "col"), below, SHEET, "col", "min_col", "max_col")
    return joined.groupBy(*SHEET, "min_row", "min_col", "max_row", "max_col", "header_row", "value").agg(F.count(F.lit(1)).alias("n_classes"))


def number(c: str):
    return F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("int"))


def merged_lessons(ranges: DataFrame, context: DataFrame, classes: DataFrame) -> DataFrame:
    """Every class and every numbered period inside a range gets its whole text. Day and session come from the range's top
    row, else from its first row that has them."""
    rows = points_in_ranges(context.select(*SHEET, "row", "day", "session", number("period_text").alias("period")), ranges, SHEET, "row", "min_row", "max_row")
    each = Window.partitionBy(*SHEET, "min_row", "min_col")
    named = F.col("day").isNotNull() & F.col("session").isNotNull()
    first = F.min_by(F.struct("day", "session"), F.when(named, F.col("row"))).over(each)
    rows = rows.withColumn("at", first).where("period is not null and at is not null")
    pairs = points_in_ranges(classes.select(*SHEET, "col", "class_name"), rows, SHEET, "col", "min_col", "max_col")
    kind = F.when(F.col("n_classes") == 1, F.lit("merged_single_class")).otherwise(F.lit("merged_group"))
    return pairs.select("source", "sheet", "class_name", F.col("at.day").alias("day"), F.col("at.session").alias("session"), "period", "value", kind.alias("source_type"), F.struct(F.lit(0), "min_row", "min_col", "col", "row").alias("pos"))


def cell_lessons(cells: DataFrame, ranges: DataFrame, context: DataFrame, classes: DataFrame) -> DataFrame:
    """Filled class cells with day, session and numbered period that lie in no processed range."""
    filled = cells.withColumn("value", clean_cell(F.col("value"))).where("value <> ''").join(classes, [*SHEET, "col"])
    within = F.col("p.col").between(F.col("r.min_col"), F.col("r.max_col"))
    free = points_in_ranges(filled, ranges, SHEET, "row", "min_row", "max_row", "left_anti", within)
    placed = free.join(context, [*SHEET, "row"]).withColumn("period", number("period_text")).where("day is not null and session is not null and period is not null")
    return placed.select(*SHEET, "class_name", "day", "session", "period", "value", F.lit("cell").alias("source_type"), F.struct(F.lit(1), F.col("row").alias("min_row"), F.lit(0).alias("min_col"), F.col("col"), F.col("row")).alias("pos"))


def lessons_of(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """The facts of all sheets, each once, the first of its kind."""
    headers = header_rows(cells)
    classes, context = class_columns(cells, headers), row_context(cells, headers)
    ranges = processed_ranges(cells, merged, headers, classes)
    every = merged_lessons(ranges, context, classes).unionByName(cell_lessons(cells, ranges, context, classes))
    every = every.withColumn("value", format_subject(F.col("value"))).where("value <> ''")
    first = Window.partitionBy(*SHEET, "class_name", "day", "session", "period", "value").orderBy("pos")
    kept = every.withColumn("n", F.row_number().over(first)).where("n = 1")
    paths = cells.groupBy("source").agg(F.min("relative_path").alias("relative_path"))
    return kept.join(sheet_titles(cells), SHEET, "left").join(paths, "source").select("source", "relative_path", F.coalesce("title", F.lit("")).alias("title"), "sheet", "class_name", grade_of_class(F.col("class_name")).alias("grade"), "day", "session", "period", "value", "source_type", F.lit("").alias("ambiguity"))


def class_sessions(cells: DataFrame) -> DataFrame:
    """One record for each class, day and session of a sheet: periods (in order), values by period with empty slots filled
    in, first and last row, and text. Merged ranges play no part: a merged cell's text stands in its anchor alone."""
    cells = cells.withColumn("line", cell_line(F.col("value")))
    text = F.col("line")
    headers = header_rows(cells, "chunk")
    at = {c: F.max(F.when(F.col("col") == c, text)) for c in (1, 2, 3)}
    rows = cells.join(headers, SHEET).where(F.col("row") > F.col("header_row")).groupBy(*SHEET, "row").agg(at[1].alias("c1"), at[2].alias("c2"), at[3].alias("c3"))
    down = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    day = F.last(F.when(F.col("c1") != "", sheet_day(F.col("c1"))), True).over(down)
    session = F.last(F.when(F.col("c2") != "", sheet_session(F.col("c2"))), True).over(down)
    placed = rows.select(*SHEET, "row", day.alias("day"), session.alias("session"), period_key(F.coalesce("c3", F.lit(""))).alias("period")).where("day is not null and session is not null and period <> ''")
    names = cells.join(headers, SHEET).where((F.col("row") == F.col("header_row")) & (F.col("col") >= 4)).select(*SHEET, "col", F.upper(text).alias("class_name")).where(is_class_name(F.col("class_name")))
    filled = cells.select(*SHEET, "row", "col", text.alias("value")).where("value <> ''").join(names, [*SHEET, "col"]).join(placed, [*SHEET, "row"])
    slot, group = [*SHEET, "day", "session"], [*SHEET, "day", "session", "class_name"]
    each = filled.groupBy(*group, "period").agg(F.max_by("value", F.struct("row", "col")).alias("value"), F.min("row").alias("row_start"), F.max("row").alias("row_end"))
    spans = each.groupBy(*group).agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"))
    dense = spans.join(filled.select(*slot, "period").distinct(), slot).join(each.select(*group, "period", "value"), [*group, "period"], "left").withColumn("value", F.coalesce("value", F.lit(EMPTY_SLOT)))
    entries = F.array_sort(F.collect_list(F.struct(number_key(F.col("period")).alias("k"), F.col("period").alias("period"), F.col("value").alias("value"))))
    records = dense.groupBy(*group, "row_start", "row_end").agg(entries.alias("e")).join(sheet_titles(cells, 1), SHEET, "left")
    grade = grade_of_class(F.col("class_name"))
    lines = F.concat(
        F.array(
            F.concat(F.lit("Thời khóa biểu"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(": "), F.col("title"))).otherwise(F.lit(""))),
            F.concat(F.lit("Trang tính: "), F.col("sheet")),
            F.when(grade != "", F.concat(F.lit("Khối: "), grade)).otherwise(F.lit("")),
            F.concat(F.lit("Lớp: "), F.col("class_name")),
            F.concat(F.lit("Thứ: "), sheet_day_display(F.col("day"))),
            F.concat(F.lit("Buổi: "), sheet_session_display(F.col("session"))),
        ),
        F.transform("e", lambda x: F.concat(F.lit("Tiết "), x["period"], F.lit(": "), x["value"])),
    )
    order = F.struct("sheet", F.coalesce(F.when(F.col("day").rlike("^[0-9]+$"), F.col("day").try_cast("int")), F.lit(99)).alias("d"), F.when(F.col("session") == "S", 0).otherwise(1).alias("s"), F.coalesce(F.regexp_extract("class_name", "[0-9]+", 0).try_cast("int"), F.lit(99)).alias("c"), "class_name")
    return records.select(
        "source", "sheet", "day", "session", "class_name", grade.alias("grade"), F.transform("e", lambda x: x["period"]).alias("periods"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["period"], x["value"]))).alias("values"), "row_start", "row_end",
        F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("text"), F.row_number().over(Window.partitionBy("source").orderBy(order)).alias("n"),
    )


def with_blocks(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each record with the id of the block of its first row, else of its source's first block. blocks: source, sheet, row,
    block_index, block_id."""
    own = blocks.groupBy("source", "sheet", "row").agg(F.max_by("block_id", "block_index").alias("own"))
    first = blocks.groupBy("source").agg(F.min_by("block_id", "block_index").alias("first"))
    return records.join(own.withColumnRenamed("row", "row_start"), ["source", "sheet", "row_start"], "left").join(first, "source", "left").withColumn("block_id", F.coalesce("own", "first")).drop("own", "first")
