"""The pipeline's tables as views of the synthetic ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.operators.lexical import LexicalIndex, read_index, write_index
from lumenbase.operators.proximity import ProximityGraph, read_graph, write_graph
from lumenbase.plans.registry import Rows, sql_literal
from lumenbase.sources.shared import built_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read. A row group is read by one task: where the texts (or the events that lessons are made of) come in
    fewer splits than there are cores, they are dealt over all cores; a table of a cluster's size has more splits than that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "events") and df.rdd.getNumPartitions() < cores else df


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their sources; the id numbers them."""
    kind = F.when(F.col("doc_id") % 10 < 5, "docx").when(F.col("doc_id") % 10 < 8, "pdf").otherwise("xlsx")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("chunk_index"), kind.alias("file_type"), F.col("text").alias("document"))


CHUNKS = """chunks AS (
    SELECT source AS file_id, doc_id AS chunk_index, CASE WHEN doc_id % 10 < 5 THEN 'docx' WHEN doc_id % 10 < 8 THEN 'pdf' ELSE 'xlsx' END AS file_type, text AS document FROM documents)"""


def vector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding")
    return chunk_view(spark, sf_dir).join(vectors, "chunk_index")


VECTORS = "vectors AS (SELECT chunks.*, CAST(embedding AS DOUBLE[]) AS embedding FROM chunks JOIN embeddings ON vec_id = chunk_index)"

QUESTIONS = Rows("question_id bigint, question string", [(0, "that with from these"), (1, "der und den die"), (2, "la de en que por"), (3, "Ering, was for: it"), (4, "THAT THE ON")])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question i has the vector with id i. A batch of questions is small, and comes from outside the tables."""
    ids = [q for q, _ in QUESTIONS.rows]
    vectors = {r[0]: r[1] for r in table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", F.col("embedding").cast("array<double>")).collect()}
    return spark.createDataFrame([(q, text, vectors[q]) for q, text in QUESTIONS.rows if q in vectors], "question_id long, question string, vector array<double>")


def stored_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The lexical index of all chunks, written at its first use in a session. No query looks substrings up in it: it has no
    stored grams."""
    return read_index(spark, built_once(spark, "index", [f"{sf_dir}/documents.parquet"], lambda path: write_index(chunk_view(spark, sf_dir), path, grams=False)), grams=False)


def stored_graph(spark: SparkSession, sf_dir: str) -> ProximityGraph:
    """The proximity graph of all vectors, written at its first use in a session."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return read_graph(spark, built_once(spark, "graph", [f"{sf_dir}/embeddings.parquet"], lambda path: write_graph(rows, path)))


ASKED = QUESTIONS.sql("asked")


def lesson_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    grade = (6 + F.col("user_id") % 7).cast("string")
    return e.select(
        F.concat(F.lit("tkb"), (F.floor(F.col("event_id") / 6) % 3).cast("string")).alias("source"), F.lit("TKB").alias("sheet"),
        F.concat(grade, F.lit("A"), (1 + F.floor(F.col("user_id") / 7) % 4).cast("string")).alias("class_name"), grade.alias("grade"), (2 + F.col("event_id") % 6).cast("string").alias("day"),
        F.when(F.hour("ts") < 12, "S").otherwise("C").alias("session"), (1 + F.col("event_id") % 5).cast("int").alias("period"),
        F.concat(F.col("event_type"), F.lit(" - "), F.get_json_object("props", "$.k")).alias("value"), F.lit("").alias("ambiguity"), F.col("event_id").alias("pos"),
    )


LESSONS = """lessons AS (
    SELECT 'tkb' || ((event_id // 6) % 3) AS source, 'TKB' AS sheet, (6 + user_id % 7) || 'A' || (1 + (user_id // 7) % 4) AS class_name, CAST(6 + user_id % 7 AS VARCHAR) AS grade,
           CAST(2 + event_id % 6 AS VARCHAR) AS day, CASE WHEN hour(ts) < 12 THEN 'S' ELSE 'C' END AS session, CAST(1 + event_id % 5 AS INTEGER) AS period,
           event_type || ' - ' || json_extract_string(props, '$.k') AS value, event_id AS pos FROM events)"""


def block_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: every third begins with a numeral, every fourth counts as a table."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("block_index", "line"))
    text = F.when(F.col("block_index") % 3 == 1, F.concat(F.lit("II. "), "line")).otherwise(F.col("line"))
    return lines.select("file_id", "block_index", F.when(F.col("block_index") % 4 == 2, "table").otherwise("paragraph").alias("block_type"), text.alias("text"))


BLOCKS = """blocks AS (
    SELECT file_id, block_index, CASE WHEN block_index % 4 = 2 THEN 'table' ELSE 'paragraph' END AS block_type, CASE WHEN block_index % 3 = 1 THEN 'II. ' || line ELSE line END AS text
    FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS block_index, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def messages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("pos"), "role", F.col("text").alias("content"))


MESSAGES = "messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS pos, role, text AS content FROM conversations)"

SCHOOL = Rows(
    "question_id int, question string",
    [
        (1, "Thứ 2 buổi sáng lớp 10A1 có những môn nào?"), (2, "lớp 10A1 thứ 3 tiết 2 buổi chiều"), (3, "TKB lớp 12A3 thứ hai đến thứ tư"), (4, "tkb khối 11 thứ bảy"),
        (5, "lớp 10A1 có 5 tiết buổi sáng thứ 4"), (6, "tiết 1-3 lớp 6A2 thứ sáu"), (7, "tiết 4 và 5 lớp 7A1"), (8, "thứ 2 lớp 10A1 học gì"), (9, "tiết 5-2 lớp 6A1"),
        (10, "thứ 2 và thứ 3 học môn gì"), (11, "thứ 5, thứ 2 lớp 9A1"), (12, "Hiệu trưởng của trường là ai?"), (13, "tiết 1 đến 3 lớp 6A2"), (14, "thứ 2 - thứ 5"), (15, "lớp 10A1 sáng chiều"),
        (16, "lớp 8A2 thứ 7 sáng chiều"), (17, "lớp 9a3 buổi chiều thứ tư tiết 3 và 4"),
    ],
)

#: What the engine dialect makes of SCHOOL, written out: the oracle doesn't parse.
PREDICATES = Rows(
    "question_id int, class_name string, grade string, days array<string>, sessions array<string>, periods array<int>, mode string",
    [
        (1, "10A1", None, ["2"], ["S"], [], "timetable"), (2, "10A1", None, ["3"], ["C"], [2], "lookup"), (3, "12A3", None, ["2", "3", "4"], [], [], "timetable"), (4, None, "11", ["7"], [], [], "timetable"),
        (5, "10A1", None, ["4"], ["S"], [1, 2, 3, 4, 5], "timetable"), (6, "6A2", None, ["6"], [], [1, 2, 3], "timetable"), (7, "7A1", None, [], [], [4], "lookup"), (8, "10A1", None, ["2"], [], [], "lookup"),
        (9, "6A1", None, [], [], [5], "lookup"), (10, None, None, ["2", "3"], [], [], "timetable"), (11, "9A1", None, ["2", "5"], [], [], "timetable"), (12, None, None, [], [], [], "lookup"),
        (13, "6A2", None, [], [], [1, 2, 3], "timetable"), (14, None, None, ["2", "3", "4", "5"], [], [], "timetable"), (15, "10A1", None, [], ["S", "C"], [], "timetable"),
        (16, "8A2", None, ["7"], ["S", "C"], [], "timetable"), (17, "9A3", None, ["4"], ["C"], [3], "lookup"),
    ],
)


def picked(items: list[str], index) -> F.Column:
    """One of the items, by a number from 0."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


DAY_WORDS = ["hai", "ba", "tư", "năm", "sáu", "bảy"]


def slot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lesson of each class, day, session and period of a source: what a sheet's cell shows."""
    first = F.min_by("value", "pos")
    return lesson_view(spark, sf_dir).groupBy("source", "class_name", "grade", "day", "session", "period").agg(first.alias("value"))


SLOTS = f"{LESSONS}, slots AS (SELECT source, class_name, grade, day, session, period, arg_min(value, pos) AS value FROM lessons GROUP BY ALL)"


def merged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each half day of a source, the last two periods of two neighbouring classes, twice, are one merged range."""
    halves = slot_view(spark, sf_dir).select("source", "day", "session").distinct().withColumn("min_col", F.explode(F.array(F.lit(8), F.lit(20))))
    top = first_row(F.col("day"), F.col("session")) + 3
    return halves.select("source", F.lit("TKB").alias("sheet"), top.cast("int").alias("min_row"), F.col("min_col").cast("int"), (top + 1).cast("int").alias("max_row"), (F.col("min_col") + F.when(F.col("min_col") == 8, 1).otherwise(0)).cast("int").alias("max_col"))


def first_row(day, session):
    """The sheet row of a half day's first period."""
    return 3 + (day.cast("int") - 2) * 10 + F.when(session == "C", 5).otherwise(0)


def cell_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each source: a title, a header with 28 classes, and a row for each day, session and period. Day and session
    stand in the first row that has them; of a merged range only the anchor is filled."""
    slots = slot_view(spark, sf_dir)
    sources = slots.select("source").distinct()
    grade, number = F.col("grade").cast("int"), F.split("class_name", "A")[1].cast("int")
    col = 3 + (grade - 6) * 4 + number
    row = first_row(F.col("day"), F.col("session")) + F.col("period") - 1
    values = slots.select("source", row.cast("int").alias("row"), col.cast("int").alias("col"), "value")
    inside = (F.col("row") - 3) % 5 >= 3
    anchor = ((F.col("row") - 3) % 5 == 3) & F.col("col").isin(8, 20)
    values = values.where(~(inside & F.col("col").isin(8, 9, 20)) | anchor)
    names = sources.select("source", F.posexplode(F.array(*[F.lit(f"{g}A{k}") for g in range(6, 13) for k in range(1, 5)])).alias("i", "value")).select("source", F.lit(2).alias("row"), (F.col("i") + 4).alias("col"), "value")
    words = sources.select("source", F.posexplode(F.array(*[F.lit(w) for w in ("Thứ", "Buổi", "Tiết")])).alias("i", "value")).select("source", F.lit(2).alias("row"), (F.col("i") + 1).alias("col"), "value")
    title = sources.select("source", F.lit(1).alias("row"), F.lit(1).alias("col"), F.concat(F.lit("TKB  tuần "), "source").alias("value"))
    lines = sources.withColumn("row", F.explode(F.sequence(F.lit(3), F.lit(62)))).withColumn("at", F.col("row") - 3)
    days = lines.where("at % 10 = 0").select("source", "row", F.lit(1).alias("col"), (2 + F.floor(F.col("at") / 10)).cast("string").alias("value"))
    halves = lines.where("at % 5 = 0").select("source", "row", F.lit(2).alias("col"), F.when(F.col("at") % 10 == 0, "S").otherwise("C").alias("value"))
    periods = lines.select("source", "row", F.lit(3).alias("col"), (1 + F.col("at") % 5).cast("string").alias("value"))
    every = values
    for part in (names, words, title, days, halves, periods):
        every = every.unionByName(part)
    return every.select("source", F.concat(F.lit("a/"), "source", F.lit(".xlsx")).alias("relative_path"), F.lit("TKB").alias("sheet"), "row", "col", "value")


CELLS = f"""{SLOTS}, sources AS (SELECT DISTINCT source FROM slots), sheet_lines AS (SELECT source, row, row - 3 AS nth FROM sources, range(3, 63) AS r(row)),
    sheet_values AS (SELECT source, 3 + (CAST(day AS INTEGER) - 2) * 10 + CASE WHEN session = 'C' THEN 5 ELSE 0 END + period - 1 AS row, 3 + (CAST(grade AS INTEGER) - 6) * 4 + CAST(string_split(class_name, 'A')[2] AS INTEGER) AS col, value FROM slots),
    sheet_cells AS (
        SELECT * FROM sheet_values WHERE NOT ((row - 3) % 5 >= 3 AND col IN (8, 9, 20)) OR ((row - 3) % 5 = 3 AND col IN (8, 20))
        UNION ALL SELECT source, 2, 3 + (g - 6) * 4 + k, g || 'A' || k FROM sources, range(6, 13) AS a(g), range(1, 5) AS b(k)
        UNION ALL SELECT source, 2, 1, 'Thứ' FROM sources UNION ALL SELECT source, 2, 2, 'Buổi' FROM sources UNION ALL SELECT source, 2, 3, 'Tiết' FROM sources
        UNION ALL SELECT source, 1, 1, 'TKB  tuần ' || source FROM sources
        UNION ALL SELECT source, row, 1, CAST(2 + nth // 10 AS VARCHAR) FROM sheet_lines WHERE nth % 10 = 0
        UNION ALL SELECT source, row, 2, CASE WHEN nth % 10 = 0 THEN 'S' ELSE 'C' END FROM sheet_lines WHERE nth % 5 = 0
        UNION ALL SELECT source, row, 3, CAST(1 + nth % 5 AS VARCHAR) FROM sheet_lines),
    cells AS (SELECT source, 'a/' || source || '.xlsx' AS relative_path, 'TKB' AS sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value FROM sheet_cells),
    merged AS (SELECT source, 'TKB' AS sheet, CAST(m AS INTEGER) AS min_row, c AS min_col, CAST(m + 1 AS INTEGER) AS max_row, CASE WHEN c = 8 THEN 9 ELSE c END AS max_col FROM (
        SELECT DISTINCT source, 3 + (CAST(day AS INTEGER) - 2) * 10 + CASE WHEN session = 'C' THEN 5 ELSE 0 END + 3 AS m FROM slots), (VALUES (8), (20)) AS w(c))"""


def period_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one period: headers for day, session and period, then a line for each class. The last source is no sheet."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_name", "value"))), lambda x: F.concat(x["class_name"], F.lit(": "), x["value"])), "\n")
    at = F.col("day").cast("long") * 100 + F.when(F.col("session") == "C", 50).otherwise(0) + F.col("period")
    kind = F.when(F.col("source") == "tkb2", "pdf").otherwise("xlsx")
    head = F.concat(F.lit("Thứ: "), "day", F.lit("\nBuổi: "), "session", F.lit("\nTiết: "), F.col("period").cast("string"), F.lit("\n"))
    grouped = slot_view(spark, sf_dir).groupBy("source", "day", "session", "period").agg(lines.alias("lines"))
    return grouped.select(F.col("source").alias("file_id"), at.alias("chunk_index"), kind.alias("file_type"), F.concat(head, "lines").alias("document"))


PERIOD_CHUNKS = f"""{SLOTS}, docs AS (SELECT source AS file_id, CAST(day AS BIGINT) * 100 + CASE WHEN session = 'C' THEN 50 ELSE 0 END + period AS chunk_index, CASE WHEN source = 'tkb2' THEN 'pdf' ELSE 'xlsx' END AS file_type,
    'Thứ: ' || day || chr(10) || 'Buổi: ' || session || chr(10) || 'Tiết: ' || period || chr(10) || string_agg(class_name || ': ' || value, chr(10) ORDER BY class_name) AS document FROM slots GROUP BY source, day, session, period)"""


def session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one class, day and session with a line for each period. The last source is no sheet."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period", "value"))), lambda x: F.concat(F.lit("Tiết "), x["period"].cast("string"), F.lit(": "), x["value"])), "\n")
    at = F.col("grade").cast("long") * 10_000 + F.split("class_name", "A")[1].cast("long") * 1000 + F.col("day").cast("long") * 10 + F.when(F.col("session") == "C", 1).otherwise(0)
    half = F.when(F.col("session") == "S", "Sáng (S)").otherwise("Chiều (C)")
    head = F.concat(F.lit("Thời khóa biểu\nTrang tính: TKB\nKhối: "), "grade", F.lit("\nLớp: "), "class_name", F.lit("\nThứ: Thứ X ("), "day", F.lit(")\nBuổi: "), half, F.lit("\n"))
    grouped = slot_view(spark, sf_dir).groupBy("source", "class_name", "grade", "day", "session").agg(lines.alias("lines"))
    return grouped.select(F.col("source").alias("file_id"), at.alias("chunk_index"), F.when(F.col("source") == "tkb2", "pdf").otherwise("xlsx").alias("file_type"), F.concat(head, "lines").alias("document"))


SESSION_CHUNKS = f"""{SLOTS}, docs AS (SELECT source AS file_id, CAST(grade AS BIGINT) * 10000 + CAST(string_split(class_name, 'A')[2] AS BIGINT) * 1000 + CAST(day AS BIGINT) * 10 + CASE WHEN session = 'C' THEN 1 ELSE 0 END AS chunk_index,
    CASE WHEN source = 'tkb2' THEN 'pdf' ELSE 'xlsx' END AS file_type, class_name, grade AS chunk_grade, day, session, list(CAST(period AS VARCHAR)) AS periods FROM slots GROUP BY source, class_name, grade, day, session)"""


def question_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question: one of ten forms filled in with an event's lesson."""
    c, g, d, p = F.col("class_name"), F.col("grade"), F.col("day"), F.col("period")
    word = picked(DAY_WORDS, d.cast("int") - 2)
    half = F.when(F.col("session") == "S", "sáng").otherwise("chiều")
    other = (2 + (d.cast("int") - 1) % 6).cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    forms = [
        text("Thứ ", d, " buổi ", half, " lớp ", c, " có những môn nào?"), text("lớp ", c, " thứ ", word, " tiết ", p, " buổi ", half), text("TKB lớp ", c, " thứ hai đến thứ ", word), text("tkb khối ", g, " thứ ", d),
        text("lớp ", c, " có ", p + 1, " tiết buổi sáng thứ ", d), text("tiết ", p, "-", p + 2, " lớp ", c, " thứ ", word), text("tiết ", p, " và ", p + 1, " lớp ", c), text("thứ ", d, " và thứ ", other, " học môn gì"),
        text("Hiệu trưởng của trường là ai? ", F.col("pos")), text("lớp ", F.lower(c), "   sáng chiều"),
    ]
    chosen = F.coalesce(*[F.when(F.col("pos") % 10 == k, f) for k, f in enumerate(forms)])
    return lesson_view(spark, sf_dir).select(F.col("pos").alias("question_id"), chosen.alias("question"))


WORD = f"{sql_literal(DAY_WORDS)}[CAST(day AS INTEGER) - 1]"
HALF = "CASE session WHEN 'S' THEN 'sáng' ELSE 'chiều' END"
OTHER = "CAST(2 + (CAST(day AS INTEGER) - 1) % 6 AS VARCHAR)"
#: The questions with the fields that they were made from: the oracle needs no parser.
ASKED_OF_LESSONS = f"""{LESSONS}, asked AS (SELECT pos AS question_id, CAST(pos % 10 AS INTEGER) AS form, class_name AS c, grade AS g, day AS d, session AS s, period AS p, {OTHER} AS other,
    CASE pos % 10 WHEN 0 THEN 'Thứ ' || day || ' buổi ' || {HALF} || ' lớp ' || class_name || ' có những môn nào?' WHEN 1 THEN 'lớp ' || class_name || ' thứ ' || {WORD} || ' tiết ' || period || ' buổi ' || {HALF}
        WHEN 2 THEN 'TKB lớp ' || class_name || ' thứ hai đến thứ ' || {WORD} WHEN 3 THEN 'tkb khối ' || grade || ' thứ ' || day WHEN 4 THEN 'lớp ' || class_name || ' có ' || (period + 1) || ' tiết buổi sáng thứ ' || day
        WHEN 5 THEN 'tiết ' || period || '-' || (period + 2) || ' lớp ' || class_name || ' thứ ' || {WORD} WHEN 6 THEN 'tiết ' || period || ' và ' || (period + 1) || ' lớp ' || class_name
        WHEN 7 THEN 'thứ ' || day || ' và thứ ' || {OTHER} || ' học môn gì' WHEN 8 THEN 'Hiệu trưởng của trường là ai? ' || pos ELSE 'lớp ' || lower(class_name) || '   sáng chiều' END AS question FROM lessons),
    named AS (SELECT question_id, form, question, CASE WHEN form IN (0, 1, 2, 4, 5, 6, 9) THEN c END AS class_name, CASE WHEN form = 3 THEN g END AS grade,
        CASE WHEN form IN (0, 1, 3, 4, 5) THEN [d] WHEN form = 2 THEN list_transform(range(2, CAST(d AS BIGINT) + 1), lambda x: CAST(x AS VARCHAR)) WHEN form = 7 THEN list_sort([d, other]) ELSE [] END AS days, d, other, s, p FROM asked)"""


def subject_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, value: cells with lessons and teachers in seven forms."""
    e, k = F.col("event_type"), F.get_json_object("props", "$.k")
    forms = [
        F.concat(e, F.lit(" - Thầy "), k, F.lit(";  C - Cô D[P"), k, F.lit("]")), F.concat(e, F.lit("-"), k), F.lit(" ; ;"), F.lit("[TRỐNG]"),
        F.concat(e, F.lit("  -  An [P1] ; Văn "), k), F.concat(e, F.lit("-T."), k, F.lit(";[TRỐNG]")), F.lit(""),
    ]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.coalesce(*[F.when(F.col("event_id") % 7 == i, f) for i, f in enumerate(forms)]).alias("value"))


SUBJECTS = """v AS (SELECT event_id AS n, CASE event_id % 7 WHEN 0 THEN event_type || ' - Thầy ' || k || ';  C - Cô D[P' || k || ']' WHEN 1 THEN event_type || '-' || k WHEN 2 THEN ' ; ;' WHEN 3 THEN '[TRỐNG]'
    WHEN 4 THEN event_type || '  -  An [P1] ; Văn ' || k WHEN 5 THEN event_type || '-T.' || k || ';[TRỐNG]' ELSE '' END AS value FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))"""
