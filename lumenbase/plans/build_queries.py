"""Queries of the offline build: blocks of all file types to chunks, manifests and flat metadata; and of answering in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenbase.functions.text import numbered_id
from lumenbase.operators import answering as A
from lumenbase.operators import chunking as C
from lumenbase.operators import fusion as R
from lumenbase.operators import lexical as B
from lumenbase.operators import reshape as U
from lumenbase.operators import search as X
from lumenbase.plans import search_queries as Q
from lumenbase.plans import sql as S
from lumenbase.plans import timetable_queries as H
from lumenbase.plans.registry import query
from lumenbase.plans.views import BLOCKS, LESSONS, SCHOOL, block_view, cell_view, chunk_view, lesson_view, questions, table, vector_view
from lumenbase.sources.shared import built_once, kept
from lumenbase.sources.tables import embedded, read_jsonl, read_vectors, write_jsonl, write_vectors
from lumenbase.sources.tables import flat_metadata as flat

HEADING = r"regexp_matches(text, '(?i)^[IVXLC]+[.)]\s+')"
#: Blocks with their clean text, section and kind, of files that are docx, pdf or xlsx by their number.
TYPED = rf"""{BLOCKS}, typed AS (SELECT file_id, block_index, CASE WHEN CAST(file_id AS BIGINT) % 10 < 5 THEN 'docx' WHEN CAST(file_id AS BIGINT) % 10 < 8 THEN 'pdf' ELSE 'xlsx' END AS file_type, block_type AS old_type, text,
        coalesce(last_value(CASE WHEN {HEADING} THEN text END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY block_index ROWS UNBOUNDED PRECEDING), 'Phần mở đầu') AS running FROM blocks),
    cleaned AS (SELECT file_id, block_index, file_type, {S.clean('text')} AS c, CASE file_type WHEN 'docx' THEN old_type WHEN 'pdf' THEN 'page' ELSE 'row' END AS block_type, CASE WHEN file_type = 'docx' THEN running END AS section,
        CASE WHEN file_type = 'pdf' THEN block_index + 1 END AS page, CASE WHEN file_type = 'xlsx' THEN 'TKB' END AS sheet, CASE WHEN file_type = 'xlsx' THEN block_index + 1 END AS row FROM typed),
    kinds AS (SELECT *, CASE WHEN block_type = 'table' THEN 'table' WHEN file_type = 'docx' AND regexp_matches(c, '(?i)^[IVXLC]+[.)]\s+') THEN 'heading' ELSE 'text' END AS kind FROM cleaned),
    split AS (SELECT *, CASE WHEN c = '' THEN [] WHEN kind = 'heading' OR file_type = 'xlsx' THEN [c] WHEN length(c) <= CASE WHEN block_type = 'table' THEN 5000 ELSE 1400 END THEN [c]
        WHEN block_type = 'table' THEN {S.packed('string_split(c, chr(10))', 5000)} ELSE {S.packed('string_split(c, chr(10))', 1400)} END AS parts FROM kinds),
    parted AS (SELECT * EXCLUDE (c, parts), unnest(parts) AS text, generate_subscripts(parts, 1) AS part FROM split),
    listed AS (SELECT file_id, list([{{'kind': kind, 'section': section, 'text': text, 'idx': [block_index], 'types': [block_type]}}] ORDER BY block_index, part) AS xs FROM parted WHERE file_type = 'docx' GROUP BY file_id),
    folded AS (SELECT file_id, list_reduce(xs, lambda a, x: CASE WHEN x[1].kind <> 'text' OR a[-1].kind = 'table' OR a[-1].section <> x[1].section OR length(a[-1].text) + 1 + length(x[1].text) > 1400 THEN a || x
        ELSE a[:-2] || [{{'kind': a[-1].kind, 'section': a[-1].section, 'text': a[-1].text || chr(10) || x[1].text, 'idx': a[-1].idx || x[1].idx, 'types': a[-1].types || x[1].types}}] END) AS made FROM listed),
    flowing AS (SELECT file_id, CAST(generate_subscripts(made, 1) - 1 AS INTEGER) AS chunk_index, unnest(made) AS m FROM folded),
    chunked AS (SELECT file_id, 'docx' AS file_type, chunk_index, m.idx AS idx, list_sort(list_distinct(m.types)) AS types, m.text AS text FROM flowing
        UNION ALL SELECT file_id, file_type, CAST(row_number() OVER (PARTITION BY file_id ORDER BY block_index, part) - 1 AS INTEGER), [block_index], [block_type], text FROM parted WHERE file_type <> 'docx'),
    made AS (SELECT k.*, k.file_id || '-c' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS id, array_to_string(list_transform(idx, lambda i: k.file_id || '-b' || lpad(CAST(i AS VARCHAR), 5, '0')), ',') AS block_ids, array_to_string(types, ',') AS block_types,
        b.section, b.page, b.sheet, b.row, 'Tên tài liệu: d' || k.file_id || chr(10) || CASE WHEN b.section <> '' THEN 'Phần: ' || b.section || chr(10) ELSE '' END || 'Nội dung:' || chr(10) || k.text AS retrieval_text, CAST(length(k.text) AS INTEGER) AS char_count
        FROM chunked AS k JOIN cleaned AS b ON b.file_id = k.file_id AND b.block_index = k.idx[1])"""


def typed_blocks(spark, sf_dir):
    """Lines of documents as schemas.BLOCKS, of files that are docx, pdf or xlsx by their number."""
    rows = C.running_section(block_view(spark, sf_dir))
    number = F.col("file_id").cast("long")
    kind = F.when(number % 10 < 5, "docx").when(number % 10 < 8, "pdf").otherwise("xlsx")
    rows = rows.withColumn("file_type", kind)
    docx, pdf, xlsx = (F.col("file_type") == k for k in ("docx", "pdf", "xlsx"))
    at = (F.col("block_index") + 1).cast("int")
    location = F.struct(F.when(pdf, at).alias("page"), F.when(docx, F.col("section")).alias("section"), F.when(docx, at).alias("item_index"), F.lit(None).cast("string").alias("style"), F.lit(None).cast("int").alias("table_number"), F.when(xlsx, "TKB").alias("sheet"), F.when(xlsx, at).alias("row"))
    types = F.when(docx, F.col("block_type")).when(pdf, "page").otherwise("row")
    name = F.concat(F.lit("d"), "file_id")
    return rows.select(numbered_id(F.col("file_id"), "b", F.col("block_index")).alias("id"), "file_id", name.alias("source"), name.alias("relative_path"), "file_type", "block_index", types.alias("block_type"), "text", location.alias("location"))


def shown(chunks):
    return chunks.withColumn("block_ids", F.array_join("block_ids", ",")).withColumn("block_types", F.array_join("block_types", ","))


@query(f"WITH {TYPED} SELECT id, file_id, file_type, chunk_index, block_ids, block_types, section, page, sheet, row, text, retrieval_text, char_count FROM made")
def build_chunks(spark, sf_dir):
    rows = shown(C.build_chunks(typed_blocks(spark, sf_dir)))
    return rows.select("id", "file_id", "file_type", "chunk_index", "block_ids", "block_types", *[f"location.{f}" for f in ("section", "page", "sheet", "row")], "text", "retrieval_text", "char_count")


@query(f"WITH {TYPED} SELECT file_id, chunk_index AS n, array_to_string(idx, ',') AS block_indexes, block_types, text FROM made WHERE file_type = 'docx'")
def flowing_chunks(spark, sf_dir):
    blocks = typed_blocks(spark, sf_dir).where("file_type = 'docx'").withColumn("section", F.col("location.section"))
    return C.flowing_chunks(blocks).withColumn("block_indexes", F.array_join(F.transform("block_indexes", lambda i: i.cast("string")), ",")).withColumn("block_types", F.array_join("block_types", ","))


@query(f"WITH {TYPED} SELECT file_id, block_index, CAST(part - 1 AS INTEGER) AS part, text FROM parted WHERE file_type = 'pdf'")
def paged_chunks(spark, sf_dir):
    return C.paged_chunks(typed_blocks(spark, sf_dir).where("file_type = 'pdf'"))


@query(f"WITH {TYPED} SELECT file_id, 'd' || file_id AS source, file_type, count(*) AS blocks, coalesce(any_value(n), 0) AS chunks FROM cleaned LEFT JOIN (SELECT file_id, count(*) AS n FROM made GROUP BY file_id) USING (file_id) GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, (SELECT count(*) FROM cleaned), (SELECT count(*) FROM made)")
def file_manifest(spark, sf_dir):
    blocks = typed_blocks(spark, sf_dir)
    return C.build_manifest(blocks, C.build_chunks(blocks))


@query(f"WITH {TYPED} SELECT id, retrieval_text AS document, file_id, 'd' || file_id AS source, 'd' || file_id AS relative_path, file_type, chunk_index, block_types, coalesce(section, '') AS section, coalesce(CAST(page AS VARCHAR), '') AS page, '' AS \"table\", coalesce(sheet, '') AS sheet, coalesce(CAST(row AS VARCHAR), '') AS row, char_count FROM made")
def flat_metadata(spark, sf_dir):
    return flat(C.build_chunks(typed_blocks(spark, sf_dir)))


@query(f"""WITH {H.RECORDS}, texts AS (SELECT source, sheet, day, session, class_name, row_start, row_end, string_agg(period, ',' ORDER BY CAST(period AS INTEGER)) AS periods FROM dense GROUP BY ALL),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY CAST(day AS INTEGER), session = 'C', CAST(regexp_extract(class_name, '\\d+') AS INTEGER), class_name) - 1 AS INTEGER) AS chunk_index FROM texts)
    SELECT source || '-c' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS id, source, chunk_index, source || '-b' || lpad(CAST(CASE WHEN row_start % 4 = 0 THEN 0 ELSE row_start - 1 END AS VARCHAR), 5, '0') AS block_ids, 'row' AS block_types,
        sheet, CASE WHEN row_start % 4 = 0 THEN 1 ELSE row_start END AS row, row_start, row_end, day, session, class_name, regexp_extract(class_name, '^(\\d+)A', 1) AS grade, periods FROM n""")
def sheet_chunks(spark, sf_dir):
    """Chunks of sheets, three rows in four of which have a block."""
    cells = cell_view(spark, sf_dir)
    texts = C.row_text(cells).where("row % 4 <> 0")
    location = F.struct(*[F.lit(None).cast(k).alias(f) for f, k in (("page", "int"), ("section", "string"), ("item_index", "int"), ("style", "string"), ("table_number", "int"))], "sheet", "row")
    index = F.col("row") - 1
    blocks = texts.select(numbered_id(F.col("source"), "b", index).alias("id"), F.col("source").alias("file_id"), "source", F.col("source").alias("relative_path"), F.lit("xlsx").alias("file_type"), index.alias("block_index"), F.lit("row").alias("block_type"), "text", location.alias("location"))
    records = kept(U.class_sessions(cells).withColumn("file_id", F.col("source")), "records")
    made = shown(C.build_chunks(blocks, records))
    return made.select("id", "source", "chunk_index", "block_ids", "block_types", *[f"location.{f}" for f in ("sheet", "row", "row_start", "row_end", "day", "session", "class_name", "grade", "periods")])


@query(f"WITH {TYPED} SELECT id, file_id, file_type, retrieval_text AS document, 64 AS dims, retrieval_text <> '' AS unit FROM made")
def vector_table(spark, sf_dir):
    """Chunks embedded by the stand-in encoder, written as the vector table and read back; text has a unit vector."""
    path = built_once(spark, "vectors", [f"{sf_dir}/documents.parquet"], lambda at: write_vectors(embedded(flat(C.build_chunks(typed_blocks(spark, sf_dir)))), at))
    rows, norm = read_vectors(spark, path), X.dot(F.col("embedding"), F.col("embedding"))
    return rows.select("id", "file_id", "file_type", "document", F.size("embedding").alias("dims"), (F.abs(norm - 1) < 1e-5).alias("unit"))


@query("SELECT doc_id, source, n_chars, text FROM documents")
def jsonl_scan(spark, sf_dir):
    """Documents written as JSON Lines and scanned again, with line breaks and quotes in them."""
    columns = ("doc_id", "source", "n_chars", "text")
    path = built_once(spark, "jsonl", [f"{sf_dir}/documents.parquet"], lambda at: write_jsonl(table(spark, sf_dir, "documents").select(*columns), at))
    return read_jsonl(spark, path, "doc_id long, source string, n_chars long, text string")


def retrieve(spark, sf_dir):
    """Document-first evidence for a batch of questions with vectors."""
    vectors, chunks, index = vector_view(spark, sf_dir), chunk_view(spark, sf_dir), Q.prose(spark, sf_dir)

    def run(asked):
        semantic, lexical = kept(X.semantic_hits(vectors, asked), "semantic"), kept(B.lexical_hits(index, asked), "lexical")
        rows = R.document_first_evidence(vectors.where(F.col("file_type").isin(*X.PROSE)), index, asked, semantic, lexical, texts=chunks)
        return rows.select("question_id", "rank", F.col("file_id").alias("source"), "document")

    return run


SLOT = f"{H.DAY.replace('day', 'days[1]', 1)} || ', ' || {H.SESSION.replace('session', 'sessions[1]', 1)} || ', tiết ' || periods[1]"


@query(f"""{Q.BOTH}, {Q.EVIDENCE}, {LESSONS}, {H.P}, {H.FOUND}, {H.ONCE},
    c AS (SELECT question_id, count(*) AS n, arg_min(value, pos) AS v, list(DISTINCT session) AS got, '| Lớp | Thứ | Buổi | Tiết | Môn học |' || chr(10) || '|---|---|---|---:|---|' || chr(10) ||
        string_agg('| ' || class_name || ' | ' || {H.DAY} || ' | ' || {H.SESSION} || ' | ' || period || ' | ' || value || ' |', chr(10) ORDER BY CAST(day AS INTEGER), session = 'C', period, class_name, pos) AS tbl FROM once GROUP BY question_id),
    k AS (SELECT p.*, coalesce(n, 0) AS n, v, tbl, array_to_string(list_transform(list_filter(p.sessions, lambda s: NOT list_contains(coalesce(got, []), s)), lambda s: CASE s WHEN 'S' THEN 'sáng' ELSE 'chiều' END), ', ') AS gap FROM p LEFT JOIN c USING (question_id)),
    said AS (SELECT question_id, CASE WHEN mode = 'timetable' AND class_name IS NULL AND grade IS NULL THEN 'Mình chưa xác định được lớp cần tra thời khóa biểu.'
        WHEN class_name IS NOT NULL AND len(days) = 1 AND len(sessions) = 1 AND len(periods) = 1 THEN CASE WHEN n > 0 THEN 'Lớp ' || class_name || ', ' || {SLOT} || ': ' || v || '.' ELSE 'Dữ liệu TKB hiện tại không có bản ghi cho lớp ' || class_name || ', ' || {SLOT} || '.' END
        WHEN mode <> 'timetable' THEN 'Mình chưa có đủ thông tin để tra thời khóa biểu.' WHEN n = 0 THEN 'Không tìm thấy dữ liệu thời khóa biểu phù hợp.'
        WHEN len(sessions) > 1 AND gap <> '' THEN tbl || chr(10) || chr(10) || 'Lưu ý: dữ liệu TKB hiện tại không có tiết ' || gap || ' cho lớp ' || coalesce(class_name, 'đã chọn') || '.' ELSE tbl END AS answer FROM k)
    SELECT question_id + 100 AS question_id, 'timetable' AS mode, answer, 'TKB trực tiếp từ Excel' AS sources FROM said WHERE question_id NOT IN (12, 14)
    UNION ALL SELECT unnest([112, 114]), 'documents', 'Chưa có đủ căn cứ để trả lời.', ''
    UNION ALL SELECT question_id, 'documents', 'rows: ' || count(*) FILTER (rank <= 6), (SELECT string_agg(file_id, ',' ORDER BY r) FROM (SELECT file_id, min(rank) AS r FROM evidence AS e WHERE e.question_id = v.question_id GROUP BY file_id ORDER BY r LIMIT 4)) FROM evidence AS v GROUP BY question_id""")
def answer_batch(spark, sf_dir):
    """The school's questions, which the timetable answers but for two, and questions for documents."""
    school = SCHOOL.frame(spark).select((F.col("question_id") + 100).cast("long").alias("question_id"), "question", F.lit(None).cast("array<double>").alias("vector"))
    asked = school.unionByName(questions(spark, sf_dir))
    rows = A.answer_batch(asked, lesson_view(spark, sf_dir), retrieve(spark, sf_dir), F.concat(F.lit("rows: "), F.col("pieces").cast("string")))
    return rows.select("question_id", "mode", "answer", F.array_join(F.transform("sources", lambda s: s["source"]), ",").alias("sources"))
