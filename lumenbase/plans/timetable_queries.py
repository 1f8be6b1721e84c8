"""Queries of timetables: lesson filters and answers, reshaping of sheets, searches over chunk texts, and the sources' text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenbase.functions.question import TIMETABLE_WORD, follow_up, has, routed_of
from lumenbase.functions.text import normalize_question
from lumenbase.operators import chunking as C
from lumenbase.operators import reshape as U
from lumenbase.operators import timetable as L
from lumenbase.plans import sql as S
from lumenbase.plans.registry import Rows, query
from lumenbase.plans.views import CELLS, LESSONS, PERIOD_CHUNKS, PREDICATES, SCHOOL, SESSION_CHUNKS, cell_view, lesson_view, merged_view, period_chunks, session_chunks, table
from lumenbase.streaming.sessions import fold_sessions

P = PREDICATES.sql("p")
FITS = """(CASE WHEN p.class_name IS NOT NULL THEN l.class_name = p.class_name WHEN p.grade IS NOT NULL THEN l.grade = p.grade ELSE true END) AND (len(p.days) = 0 OR list_contains(p.days, l.day))
    AND (len(p.sessions) = 0 OR list_contains(p.sessions, l.session)) AND (len(p.periods) = 0 OR list_contains(p.periods, l.period))"""
FOUND = f"found AS (SELECT question_id, l.* FROM lessons AS l JOIN p ON {FITS})"
ONCE = "once AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY question_id, source, sheet, class_name, day, session, period, value ORDER BY pos) = 1)"


def parsed(spark):
    return L.parsed_questions(SCHOOL.frame(spark))


def found(spark, sf_dir):
    return L.deduped(L.candidates(lesson_view(spark, sf_dir), parsed(spark)), "question_id")


@query(f"WITH {LESSONS}, {P}, {FOUND} SELECT question_id, class_name, day, session, period, value, source, pos FROM found")
def lesson_filter(spark, sf_dir):
    rows = L.candidates(lesson_view(spark, sf_dir), parsed(spark))
    return rows.select("question_id", "class_name", "day", "session", "period", "value", "source", "pos")


@query(f"WITH {LESSONS}, {P}, {FOUND}, {ONCE} SELECT question_id, class_name, day, session, period, value, source FROM once WHERE question_id IN (SELECT question_id FROM p WHERE class_name IS NOT NULL AND len(days) = 1 AND len(sessions) = 1 AND len(periods) = 1)")
def lesson_lookup(spark, sf_dir):
    return L.lookup(lesson_view(spark, sf_dir), parsed(spark)).select("question_id", "class_name", "day", "session", "period", "value", "source")


@query(f"WITH {LESSONS} SELECT source, class_name, day, session, period, value, min(pos) AS pos FROM lessons GROUP BY ALL")
def lesson_dedupe(spark, sf_dir):
    return L.deduped(lesson_view(spark, sf_dir)).select("source", "class_name", "day", "session", "period", "value", "pos")


@query(f"""WITH {LESSONS}, {P}, {FOUND}, {ONCE}, c AS (SELECT question_id, count(*) AS n, arg_min(value, pos) AS v FROM once GROUP BY question_id),
    k AS (SELECT p.question_id, coalesce(n, 0) AS n, v, CASE WHEN mode = 'timetable' AND class_name IS NULL AND grade IS NULL THEN 'class unknown' WHEN class_name IS NOT NULL AND len(days) = 1 AND len(sessions) = 1 AND len(periods) = 1 THEN 'lookup'
        WHEN mode = 'timetable' THEN 'table' ELSE 'too little known' END AS type FROM p LEFT JOIN c USING (question_id))
    SELECT question_id, type IN ('lookup', 'table') AND n > 0 AS ok, type, CASE WHEN type IN ('lookup', 'table') THEN n ELSE 0 END AS n_rows, CASE WHEN type = 'lookup' THEN v END AS first_value FROM k""")
def lesson_answer(spark, sf_dir):
    return L.answer_questions(lesson_view(spark, sf_dir), parsed(spark))


DAY = "CASE day WHEN '2' THEN 'Thứ Hai' WHEN '3' THEN 'Thứ Ba' WHEN '4' THEN 'Thứ Tư' WHEN '5' THEN 'Thứ Năm' WHEN '6' THEN 'Thứ Sáu' ELSE 'Thứ Bảy' END"
SESSION = "CASE session WHEN 'S' THEN 'Sáng' ELSE 'Chiều' END"


@query(f"""WITH {LESSONS}, {P}, {FOUND}, {ONCE} SELECT question_id, count(*) AS n_rows, '| Lớp | Thứ | Buổi | Tiết | Môn học |' || chr(10) || '|---|---|---|---:|---|' || chr(10) ||
    string_agg('| ' || class_name || ' | ' || {DAY} || ' | ' || {SESSION} || ' | ' || period || ' | ' || value || ' |', chr(10) ORDER BY CAST(day AS INTEGER), session = 'C', period, class_name, pos) AS "table" FROM once WHERE question_id IN (SELECT question_id FROM p WHERE class_name IS NOT NULL OR grade IS NOT NULL) GROUP BY question_id""")
def lesson_table_md(spark, sf_dir):
    """Questions without class and grade get no table."""
    return L.tables(found(spark, sf_dir).where("q.class_name is not null or q.grade is not null"))


@query(f"""WITH {LESSONS}, {P}, {FOUND} SELECT p.question_id, array_to_string(list_filter(p.sessions, lambda s: NOT list_contains(coalesce(g.got, []), s)), ',') AS missing
    FROM p LEFT JOIN (SELECT question_id, list(DISTINCT session) AS got FROM found GROUP BY 1) AS g USING (question_id) WHERE len(p.sessions) > 1""")
def missing_sessions(spark, sf_dir):
    return L.missing_sessions(found(spark, sf_dir), parsed(spark))


@query(f"WITH {LESSONS} SELECT pos, row_number() OVER (ORDER BY class_name, CAST(day AS INTEGER), session <> 'S', period, source, pos) AS position FROM lessons")
def lesson_load_order(spark, sf_dir):
    return L.load_order(lesson_view(spark, sf_dir)).select("pos", "position")


@query(f"WITH {LESSONS} SELECT pos, {DAY} AS day_name, {SESSION} AS session_name, value AS subject FROM lessons")
def lesson_display(spark, sf_dir):
    rows = lesson_view(spark, sf_dir).withColumn("sheet", F.col("pos").cast("string"))
    return L.lesson_records(rows).select(F.col("sheet").cast("long").alias("pos"), "day_name", "session_name", "subject")


GRID = f"""{CELLS}, t AS (SELECT *, {S.strip(S.one_space('value'))} AS v FROM cells), header AS (SELECT source, sheet, min(row) AS header_row FROM (
        SELECT source, sheet, row FROM t WHERE row <= 15 AND v IN ('Thứ', 'Buổi', 'Tiết') GROUP BY ALL HAVING count(DISTINCT v) = 3) GROUP BY ALL),
    classes AS (SELECT source, sheet, col, upper(v) AS class_name FROM t JOIN header USING (source, sheet) WHERE row = header_row AND regexp_matches(v, '(?i)^(6|7|8|9|10|11|12)A\\d+$')),
    by_row AS (SELECT source, sheet, row, max(v) FILTER (col = 1) AS c1, max(v) FILTER (col = 2) AS c2, coalesce(max(v) FILTER (col = 3), '') AS c3 FROM t JOIN header USING (source, sheet) WHERE row > header_row GROUP BY ALL),
    context AS (SELECT source, sheet, row, c3 AS period_text, last_value(CASE WHEN c1 IN ('2', '3', '4', '5', '6', '7') THEN c1 END IGNORE NULLS) OVER w AS day, last_value(CASE WHEN c2 IN ('S', 'C') THEN c2 END IGNORE NULLS) OVER w AS session
        FROM by_row WINDOW w AS (PARTITION BY source, sheet ORDER BY row ROWS UNBOUNDED PRECEDING)),
    ranges AS (SELECT m.*, a.v AS value, (SELECT count(*) FROM classes AS c WHERE c.source = m.source AND c.sheet = m.sheet AND c.col BETWEEN m.min_col AND m.max_col) AS n_classes
        FROM merged AS m JOIN header USING (source, sheet) JOIN t AS a ON a.source = m.source AND a.sheet = m.sheet AND a.row = m.min_row AND a.col = m.min_col WHERE max_row > header_row AND a.v <> ''),
    inside AS (SELECT r.source, r.sheet, c.class_name, first_value(x.day) OVER w AS day, first_value(x.session) OVER w AS session, CAST(x.period_text AS INTEGER) AS period, r.value, CASE WHEN n_classes = 1 THEN 'merged_single_class' ELSE 'merged_group' END AS source_type
        FROM ranges AS r JOIN context AS x ON x.source = r.source AND x.sheet = r.sheet AND x.row BETWEEN r.min_row AND r.max_row JOIN classes AS c ON c.source = r.source AND c.sheet = r.sheet AND c.col BETWEEN r.min_col AND r.max_col
        WHERE n_classes > 0 AND regexp_matches(x.period_text, '^[0-9]+$') WINDOW w AS (PARTITION BY r.source, r.sheet, r.min_row, r.min_col, c.col ORDER BY x.row)),
    plain AS (SELECT t.source, t.sheet, c.class_name, x.day, x.session, CAST(x.period_text AS INTEGER) AS period, t.v AS value, 'cell' AS source_type FROM t JOIN classes AS c USING (source, sheet, col) JOIN context AS x USING (source, sheet, row)
        WHERE t.v <> '' AND x.day IS NOT NULL AND x.session IS NOT NULL AND regexp_matches(x.period_text, '^[0-9]+$')
        AND NOT EXISTS (SELECT 1 FROM ranges AS r WHERE r.n_classes > 0 AND r.source = t.source AND r.sheet = t.sheet AND t.row BETWEEN r.min_row AND r.max_row AND t.col BETWEEN r.min_col AND r.max_col))"""


@query(f"WITH {GRID} SELECT source, sheet, header_row FROM header")
def grid_header(spark, sf_dir):
    return U.header_rows(cell_view(spark, sf_dir))


@query(f"WITH {GRID} SELECT source, sheet, row, period_text, day, session FROM context")
def grid_fill(spark, sf_dir):
    cells = cell_view(spark, sf_dir)
    return U.row_context(cells, U.header_rows(cells))


def grid(spark, sf_dir):
    cells, merged = cell_view(spark, sf_dir), merged_view(spark, sf_dir)
    headers = U.header_rows(cells)
    classes, context = U.class_columns(cells, headers), U.row_context(cells, headers)
    return cells, U.processed_ranges(cells, merged, headers, classes), context, classes


@query(f"WITH {GRID} SELECT source, sheet, class_name, day, session, period, value, source_type FROM plain")
def grid_unpivot(spark, sf_dir):
    return U.cell_lessons(*grid(spark, sf_dir)).drop("pos")


@query(f"WITH {GRID} SELECT source, sheet, class_name, day, session, period, value, source_type FROM inside")
def merge_expand(spark, sf_dir):
    _, ranges, context, classes = grid(spark, sf_dir)
    return U.merged_lessons(ranges, context, classes).drop("pos")


@query(f"""WITH {GRID}, every AS (SELECT * FROM inside UNION ALL SELECT * FROM plain) SELECT source, 'a/' || source || '.xlsx' AS relative_path, 'TKB tuần ' || source AS title, sheet, class_name, regexp_extract(class_name, '^(\\d+)A', 1) AS grade, day, session, period, {S.subject('value')} AS value, source_type, '' AS ambiguity FROM every""")
def sheet_lessons(spark, sf_dir):
    return U.lessons_of(cell_view(spark, sf_dir), merged_view(spark, sf_dir))


RECORDS = f"""{GRID}, filled_slots AS (SELECT t.source, t.sheet, x.day, x.session, c.class_name, x.period_text AS period, t.v AS value, t.row FROM t JOIN classes AS c USING (source, sheet, col) JOIN context AS x USING (source, sheet, row) WHERE t.v <> '' AND x.period_text <> ''),
    spans AS (SELECT source, sheet, day, session, class_name, min(row) AS row_start, max(row) AS row_end FROM filled_slots GROUP BY ALL),
    dense AS (SELECT s.*, p.period, coalesce(v.value, '[TRỐNG]') AS value FROM spans AS s JOIN (SELECT DISTINCT source, sheet, day, session, period FROM filled_slots) AS p USING (source, sheet, day, session) LEFT JOIN filled_slots AS v USING (source, sheet, day, session, class_name, period))"""


@query(f"WITH {RECORDS} SELECT source, sheet, day, session, class_name, period, value FROM dense")
def period_densify(spark, sf_dir):
    rows = U.class_sessions(cell_view(spark, sf_dir))
    return rows.select("source", "sheet", "day", "session", "class_name", F.explode("values").alias("period", "value"))


@query(f"""WITH {RECORDS} SELECT source, sheet, day, session, class_name, row_start, row_end, 'Thời khóa biểu: TKB tuần ' || source || chr(10) || 'Trang tính: ' || sheet || chr(10) || 'Khối: ' || regexp_extract(class_name, '^(\\d+)A', 1) || chr(10) || 'Lớp: ' || class_name || chr(10) ||
    'Thứ: ' || {DAY} || ' (' || day || ')' || chr(10) || 'Buổi: ' || {SESSION} || ' (' || session || ')' || chr(10) || string_agg('Tiết ' || period || ': ' || value, chr(10) ORDER BY CAST(period AS INTEGER)) AS text FROM dense GROUP BY source, sheet, day, session, class_name, row_start, row_end""")
def class_session_records(spark, sf_dir):
    return U.class_sessions(cell_view(spark, sf_dir)).select("source", "sheet", "day", "session", "class_name", "row_start", "row_end", "text")


ROW_BLOCKS = "b AS (SELECT DISTINCT source, sheet, row, row - 1 AS block_index, source || '-b' || row AS block_id FROM cells WHERE row % 4 <> 0)"


@query(f"WITH {RECORDS}, {ROW_BLOCKS} SELECT s.source, s.day, s.session, s.class_name, s.row_start, coalesce(b.block_id, s.source || '-b1') AS block_id FROM spans AS s LEFT JOIN b ON b.source = s.source AND b.sheet = s.sheet AND b.row = s.row_start")
def lineage_join(spark, sf_dir):
    """Three rows in four of a sheet have a block."""
    cells = cell_view(spark, sf_dir)
    blocks = cells.where("row % 4 <> 0").select("source", "sheet", "row", (F.col("row") - 1).alias("block_index"), F.concat("source", F.lit("-b"), F.col("row").cast("string")).alias("block_id")).distinct()
    return U.with_blocks(U.class_sessions(cells), blocks).select("source", "day", "session", "class_name", "row_start", "block_id")


@query(f"""WITH {GRID} SELECT source, sheet, row, 'Trang tính: ' || sheet || chr(10) || 'Dòng: ' || row || chr(10) || string_agg(CASE WHEN col > 26 THEN 'A' || chr(64 + col - 26) ELSE chr(64 + col) END || row || '=' || v, ' | ' ORDER BY col) AS text FROM t WHERE v <> '' GROUP BY source, sheet, row""")
def row_text(spark, sf_dir):
    return C.row_text(cell_view(spark, sf_dir))


@query(f"""WITH {GRID}, w AS (SELECT source, row, col, CASE WHEN row = 4 THEN v || chr(10) || 'x' ELSE v END AS v FROM t), l AS (SELECT source, row, 'Dòng ' || row || ': ' || string_agg('Ô ' || col || ': ' || v, ' | ' ORDER BY col) AS line FROM w WHERE v <> '' GROUP BY source, row)
    SELECT source, 1 AS table_number, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY source""")
def table_text(spark, sf_dir):
    """Cells of the fourth row have a second line."""
    cells = cell_view(spark, sf_dir).withColumn("value", F.when(F.col("row") == 4, F.concat("value", F.lit("\r\n  x"))).otherwise(F.col("value")))
    return C.table_text(cells.withColumn("table_number", F.lit(1)))


V1_Q = rf"""school_norm AS (SELECT question_id, {S.search('question')} AS q FROM school),
    v1_q AS (SELECT question_id, {S.CLASS_GRADE}, {S.DAYS}[1] AS day, CASE WHEN regexp_matches(q, '\bsáng\b') THEN 'S' WHEN regexp_matches(q, '\bchiều\b') THEN 'C' END AS session,
        list_distinct(flatten(list_transform(regexp_extract_all(q, '\btiết\s*(\d+(?:\s*(?:,|và|&|- )\s*\d+)*)', 1), lambda g: regexp_extract_all(g, '\d+')))) AS periods FROM school_norm)"""
V1_FOUND = rf"""{SCHOOL.sql('school')}, {V1_Q}, {PERIOD_CHUNKS}, v1_docs AS (SELECT *, {S.header('Thứ')} AS d, {S.header('Buổi')} AS s, {S.header('Tiết')} AS p FROM docs WHERE file_type = 'xlsx'),
    v1_found AS (SELECT question_id, file_id, chunk_index, p, CASE WHEN class_name IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN grade IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN day IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN session IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN len(periods) > 0 THEN 2 ELSE 0 END AS structured_score
        FROM v1_docs JOIN v1_q ON (day IS NULL OR d = day) AND (session IS NULL OR s = session) AND (len(periods) = 0 OR list_contains(periods, p)) AND (class_name IS NULL OR regexp_matches(document, '(?im)^\s*' || class_name || '\s*:')) AND (grade IS NULL OR regexp_matches(document, '(?im)^\s*' || grade || 'a\d+\s*:'))
        WHERE class_name IS NOT NULL OR grade IS NOT NULL OR day IS NOT NULL OR session IS NOT NULL OR len(periods) > 0),
    v1_ranked AS (SELECT question_id, file_id, chunk_index, structured_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY structured_score DESC, coalesce(try_cast(p AS INTEGER), 0), file_id, chunk_index) AS INTEGER) AS rank FROM v1_found)"""


def v1_hits(spark, sf_dir):
    return L.structured_v1(period_chunks(spark, sf_dir), SCHOOL.frame(spark))


@query(f"WITH {V1_FOUND} SELECT * FROM v1_ranked")
def structured_search_v1(spark, sf_dir):
    return v1_hits(spark, sf_dir)


RANGE_DAY = "list_position(['2', '3', '4', '5', '6', '7'], coalesce(nullif(regexp_extract({x}, '^[2-7]$'), ''), CASE {x} WHEN 'hai' THEN '2' WHEN 'ba' THEN '3' WHEN 'tư' THEN '4' WHEN 'năm' THEN '5' WHEN 'sáu' THEN '6' WHEN 'bảy' THEN '7' END)) + 1"
V4_Q = rf"""school_norm AS (SELECT question_id, {S.search('question')} AS q FROM school), v4_r AS (SELECT *, regexp_extract(q, '\bthứ\s*([2-7]|hai|ba|tư|năm|sáu|bảy)\s*(?:đến|tới)\s*(?:thứ\s*)?([2-7]|hai|ba|tư|năm|sáu|bảy){S.END}', ['a', 'b']) AS e FROM school_norm),
    v4_g AS (SELECT *, CASE WHEN e.a <> '' AND {RANGE_DAY.format(x='e.a')} <= {RANGE_DAY.format(x='e.b')} THEN list_transform(range({RANGE_DAY.format(x='e.a')}, {RANGE_DAY.format(x='e.b')} + 1), lambda x: CAST(x AS VARCHAR)) ELSE {S.DAYS} END AS days,
        list_distinct(flatten(list_transform(regexp_extract_all(q, '\btiết\s*(\d+(?:\s*(?:,|và|&|-|đến)\s*\d+)*)', 1), lambda g: CASE WHEN regexp_matches(g, 'đến') THEN list_transform(range(CAST(regexp_extract(g, '^(\d+)', 1) AS BIGINT), CAST(regexp_extract(g, '(\d+)$', 1) AS BIGINT) + 1), lambda x: CAST(x AS VARCHAR)) ELSE regexp_extract_all(g, '\d+') END))) AS named,
        try_cast(regexp_extract(q, '\b(?:gồm|có|đủ|trong)\s*(\d+)\s*tiết', 1) AS BIGINT) AS cnt FROM v4_r),
    v4_q AS (SELECT question_id, {S.CLASS_GRADE}, days, CASE WHEN regexp_matches(q, '\bsáng\b') THEN 'S' WHEN regexp_matches(q, '\bchi[eề]u\b') THEN 'C' END AS ses,
        CASE WHEN len(named) > 0 THEN named WHEN cnt BETWEEN 1 AND 10 THEN list_transform(range(1, cnt + 1), lambda x: CAST(x AS VARCHAR)) ELSE [] END AS ps, CASE WHEN len(named) = 0 AND cnt BETWEEN 1 AND 10 THEN CAST(cnt AS INTEGER) END AS period_count FROM v4_g)"""


@query(f"""WITH {SCHOOL.sql('school')}, {V4_Q}, {SESSION_CHUNKS}, f AS (SELECT question_id, file_id, chunk_index, day, session, docs.class_name, CASE WHEN v4_q.class_name IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN grade IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN len(days) > 0 THEN 3 ELSE 0 END + CASE WHEN ses IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN len(ps) > 0 THEN 2 ELSE 0 END AS structured_score
        FROM docs JOIN v4_q ON file_type = 'xlsx' AND (v4_q.class_name IS NULL OR docs.class_name = v4_q.class_name) AND (grade IS NULL OR chunk_grade = grade) AND (len(days) = 0 OR list_contains(days, day)) AND (ses IS NULL OR session = ses) AND (len(ps) = 0 OR list_has_any(ps, periods))
        WHERE v4_q.class_name IS NOT NULL OR grade IS NOT NULL OR len(days) > 0 OR ses IS NOT NULL OR len(ps) > 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CAST(day AS INTEGER), session = 'C', class_name, chunk_index, file_id) AS INTEGER) AS rank FROM f) SELECT question_id, file_id, chunk_index, structured_score, rank, round(1.0 / (60 + rank), 6) AS rrf_score FROM r""")
def structured_search_v4(spark, sf_dir):
    return L.structured_v4(session_chunks(spark, sf_dir), SCHOOL.frame(spark))


TURNS = Rows("session_id string, pos int, question string", [("a", 1, "Thứ 2 buổi sáng lớp 10A1 có những môn nào?"), ("a", 2, "còn tiết 3 thì sao"), ("a", 3, "còn buổi chiều?"), ("a", 4, "thế còn thứ 3 thì sao"), ("a", 5, "tiết 9"), ("b", 1, "tiết 3"), ("b", 2, "tkb lớp 10A2"), ("b", 3, "/reset"), ("b", 4, "còn buổi sáng?")])


def turns(spark):
    return read_turns(TURNS.frame(spark))


def read_turns(rows):
    """Turns with what their questions say, as fold_sessions takes them. rows: session_id, pos, question."""
    n, q = normalize_question(F.col("question")), F.col("q")
    said = {"class_name": q["class_name"].isNotNull(), "grade": q["grade"].isNotNull()} | {f: has(q[f]) for f in ("days", "sessions", "periods")}
    return L.parsed_questions(rows).select("session_id", "pos", (n == "/reset").alias("is_reset"), follow_up(n, said).alias("follows"), n.rlike(TIMETABLE_WORD).alias("timetable_word"), *[q[f].alias(f) for f in ("class_name", "grade", "days", "sessions", "periods")])


#: A turn's question, and what it says: reset, goes on, names the timetable, class, grade, days, sessions, periods.
TURN_FORMS = [
    ("Thứ {d} buổi sáng lớp {c} có những môn nào?", "false, false, false, c, NULL, [d], ['S'], []"),
    ("còn tiết {p} thì sao", "false, true, false, NULL, NULL, [], [], [p]"),
    ("còn buổi chiều?", "false, true, false, NULL, NULL, [], ['C'], []"),
    ("thế còn thứ {d} thì sao", "false, false, false, NULL, NULL, [d], [], []"),
    ("tiết {p}", "false, true, false, NULL, NULL, [], [], [p]"),
    ("tkb lớp {c}", "false, false, true, c, NULL, [], [], []"),
    ("/reset", "true, false, false, NULL, NULL, [], [], []"),
    ("tkb khối {g} thứ {d}", "false, false, true, NULL, g, [d], [], []"),
    ("lớp {c} thứ {d} tiết {p} buổi chiều", "false, false, false, c, NULL, [d], ['C'], [p]"),
    ("TKB lớp {c} thứ hai đến thứ tư", "false, false, true, c, NULL, ['2', '3', '4'], [], []"),
]
TURN_VALUES = """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS pos, CAST((conv_id * 3 + turn * 7 + turn * turn) % 10 AS INTEGER) AS form, CAST(2 + (conv_id + turn) % 6 AS VARCHAR) AS d, CAST(6 + conv_id % 7 AS VARCHAR) AS g,
        CAST(1 + (conv_id + turn) % 5 AS INTEGER) AS p, (6 + conv_id % 7) || 'A' || (1 + (conv_id // 7 + turn // 4) % 4) AS c FROM conversations"""
SAID_FIELDS = "is_reset, follows, timetable_word, class_name, grade, days, sessions, periods"
TOLD = " UNION ALL ".join(f"SELECT t.session_id, t.pos, s.* FROM t, LATERAL (SELECT {values}) AS s({SAID_FIELDS}) WHERE form = {k}" for k, (_, values) in enumerate(TURN_FORMS))

#: Turn after turn of every session at once. What a follow-up asks for is joined with the slots that fit, and whether there are
#: any decides which context the next turn finds.
SESSIONS = f"""RECURSIVE t AS ({TURN_VALUES}), told AS ({TOLD}), {LESSONS}, slots AS (SELECT DISTINCT class_name AS sc, grade AS sg, day AS sd, session AS ss, period AS sp FROM lessons),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM told),
    state AS (
        SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS pos, false AS ok, CAST(0 AS BIGINT) AS n_rows, CAST(NULL AS VARCHAR) AS class_name, CAST(NULL AS VARCHAR) AS grade,
               CAST(NULL AS VARCHAR) AS day, CAST(NULL AS VARCHAR) AS session, CAST(NULL AS INTEGER) AS period FROM numbered
        UNION ALL
        SELECT session_id, n, pos, hits > 0, hits,
               CASE WHEN is_reset THEN NULL WHEN hits > 0 THEN coalesce(ac, class_name) ELSE class_name END, CASE WHEN is_reset THEN NULL WHEN hits > 0 THEN coalesce(ag, grade) ELSE grade END,
               CASE WHEN is_reset THEN NULL WHEN hits > 0 AND len(ad) = 1 THEN ad[1] WHEN hits > 0 AND len(ad) > 1 THEN NULL ELSE day END,
               CASE WHEN is_reset THEN NULL WHEN hits > 0 AND len(ase) = 1 THEN ase[1] WHEN hits > 0 AND len(ase) > 1 THEN NULL ELSE session END,
               CASE WHEN is_reset THEN NULL WHEN hits > 0 AND len(ap) = 1 THEN ap[1] WHEN hits > 0 AND len(ap) > 1 THEN NULL ELSE period END
        FROM (
            SELECT session_id, n, pos, is_reset, class_name, grade, day, session, period, ac, ag, ad, ase, ap, CASE WHEN able THEN found ELSE 0 END AS hits
            FROM (SELECT asked.*, NOT is_reset AND (tword OR len(ad) > 1 OR len(ase) > 1 OR len(ap) > 1 OR (ac IS NOT NULL AND len(ap) = 0 AND (len(ad) > 0) = (len(ase) > 0))
                         OR (ac IS NOT NULL AND len(ad) > 0 AND len(ase) > 0 AND len(ap) > 0)) AS able, count(sc) AS found
            FROM (
                SELECT b.session_id, m.n, m.pos, m.is_reset, m.timetable_word AS tword, b.class_name, b.grade, b.day, b.session, b.period,
                       CASE WHEN m.follows THEN coalesce(m.class_name, b.class_name) ELSE m.class_name END AS ac, CASE WHEN m.follows THEN coalesce(m.grade, b.grade) ELSE m.grade END AS ag,
                       CASE WHEN len(m.days) = 0 AND m.follows AND b.day IS NOT NULL THEN [b.day] ELSE m.days END AS ad,
                       CASE WHEN len(m.sessions) = 0 AND m.follows AND b.session IS NOT NULL THEN [b.session] ELSE m.sessions END AS ase, m.periods AS ap
                FROM state AS b JOIN numbered AS m ON m.session_id = b.session_id AND m.n = b.n + 1
            ) AS asked LEFT JOIN slots ON (CASE WHEN ac IS NOT NULL THEN sc = ac WHEN ag IS NOT NULL THEN sg = ag ELSE false END)
                 AND (len(ad) = 0 OR list_contains(ad, sd)) AND (len(ase) = 0 OR list_contains(ase, ss)) AND (len(ap) = 0 OR list_contains(ap, sp))
            GROUP BY ALL)
        )
    )"""


def turn_view(spark, sf_dir):
    """A question for each message of each conversation: one of ten forms, filled in from the ids."""
    conv, turn = F.col("conv_id"), F.col("turn")
    grade = (6 + conv % 7).cast("string")
    name = F.concat(grade, F.lit("A"), (1 + (F.floor(conv / 7) + F.floor(turn / 4)) % 4).cast("string"))
    filled = {"d": (2 + (conv + turn) % 6).cast("string"), "g": grade, "p": (1 + (conv + turn) % 5).cast("string"), "c": name}
    question = F.element_at(F.array(*[F.lit(text) for text, _ in TURN_FORMS]), ((conv * 3 + turn * 7 + turn * turn) % 10 + 1).cast("int"))
    for k, value in filled.items():
        question = F.replace(question, F.lit("{" + k + "}"), value)
    return table(spark, sf_dir, "conversations").select(conv.cast("string").alias("session_id"), turn.cast("int").alias("pos"), question.alias("question"))


@query(f"WITH {SESSIONS} SELECT session_id, pos, ok, CAST(n_rows AS INTEGER) AS n_rows, class_name, grade, day, session, period FROM state WHERE n > 0")
def session_context(spark, sf_dir):
    return fold_sessions(read_turns(turn_view(spark, sf_dir)), lesson_view(spark, sf_dir))


@query(f"WITH t AS ({TURN_VALUES}) SELECT session_id, pos, form NOT IN (3, 6) AS timetable, form NOT IN (3, 6) OR form = 3 AND pos > 0 AS with_context FROM t")
def route_turns(spark, sf_dir):
    """Which turns the timetable answers; a mere word for going on is enough after the first turn."""
    rows, n = turn_view(spark, sf_dir), normalize_question(F.col("question"))
    return rows.select("session_id", "pos", routed_of(n).alias("timetable"), routed_of(n, F.col("pos") > 0).alias("with_context"))
