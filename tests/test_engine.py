import io
import os
import time
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenbase.operators import answering, chunking, evidence, fusion, lexical, quality, reshape, search, timetable
from lumenbase.plans.timetable_queries import TURNS, turns
from lumenbase.plans.registry import Rows
from lumenbase.sources import office, tables
from lumenbase.streaming import sessions

CELLS = Rows(
    "source string, relative_path string, sheet string, row int, col int, value string",
    [
        ("t.xlsx", "a/t.xlsx", "TKB", r, c, v)
        for r, c, v in [
            (1, 1, "TKB tuần 1"), (2, 1, "Thứ"), (2, 2, "Buổi"), (2, 3, "Tiết"), (2, 4, "10A1"), (2, 5, "10A2"), (2, 6, "11A1"),
            (3, 1, "2"), (3, 2, "S"), (3, 3, "1"), (3, 4, "Toán-An"), (3, 5, "Văn-Bình"), (4, 3, "2"), (4, 4, "Lý-Cường"), (4, 5, "Hóa-Dung"), (4, 6, "Sử-Em"),
            (5, 3, "3"), (5, 5, "Địa-Phú"), (5, 6, "Anh-Giang"), (6, 2, "C"), (6, 3, "1"), (6, 4, "ÔN HSG"), (6, 6, "Tin-Hà"),
            (7, 1, "3"), (7, 2, "S"), (7, 3, "1"), (7, 4, "Văn - Cô A; Toán - Thầy B [P1]"), (7, 6, "Toán-An"),
        ]
    ],
)
MERGED = Rows("source string, sheet string, min_row int, min_col int, max_row int, max_col int", [("t.xlsx", "TKB", 4, 4, 5, 4), ("t.xlsx", "TKB", 6, 4, 6, 5)])
SLOW = settings(deadline=None, max_examples=5, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_grid_to_lessons(spark):
    got = {(r["class_name"], r["day"] + r["session"] + str(r["period"]), r["value"], r["source_type"]) for r in reshape.lessons_of(CELLS.frame(spark), MERGED.frame(spark)).collect()}
    cell = {("10A1", "2S1", "Toán-An"), ("10A2", "2S1", "Văn-Bình"), ("10A2", "2S2", "Hóa-Dung"), ("11A1", "2S2", "Sử-Em"), ("10A2", "2S3", "Địa-Phú"), ("11A1", "2S3", "Anh-Giang"), ("11A1", "2C1", "Tin-Hà"), ("10A1", "3S1", "Văn - Cô A / Toán - Thầy B [P1]"), ("11A1", "3S1", "Toán-An")}
    assert got == {(*c, "cell") for c in cell} | {("10A1", "2S2", "Lý-Cường", "merged_single_class"), ("10A1", "2S3", "Lý-Cường", "merged_single_class"), ("10A1", "2C1", "ÔN HSG", "merged_group"), ("10A2", "2C1", "ÔN HSG", "merged_group")}


def test_grid_to_records(spark):
    got = {(r["day"] + r["session"], r["class_name"]): (r["values"], r["row_start"], r["row_end"]) for r in reshape.class_sessions(CELLS.frame(spark)).collect()}
    assert len(got) == 7 and ("2C", "10A2") not in got
    assert got["2S", "10A1"] == ({"1": "Toán-An", "2": "Lý-Cường", "3": "[TRỐNG]"}, 3, 4)
    assert got["2S", "11A1"] == ({"1": "[TRỐNG]", "2": "Sử-Em", "3": "Anh-Giang"}, 4, 5)


def test_session_turns(spark):
    lessons = reshape.lessons_of(CELLS.frame(spark), MERGED.frame(spark))
    got = {(r["session_id"], r["pos"]): r for r in sessions.fold_sessions(turns(spark), lessons).collect()}
    assert len(got) == len(TURNS.rows)
    assert [got["a", k]["ok"] for k in range(1, 6)] == [True, True, True, False, False]
    last = got["a", 5]
    assert (last["class_name"], last["day"], last["session"], last["period"]) == ("10A1", "2", "C", 3)
    assert not got["b", 1]["ok"] and got["b", 2]["ok"] and got["b", 3]["class_name"] is None and not got["b", 4]["ok"]


def test_streamed_history(spark, tmp_path):
    ddl = "session_id string, pos int, role string, content string"
    ddl += ", is_reset boolean"
    spark.createDataFrame([(s, k, "user", f"m{k}", (s, k) == ("b", 2)) for s in "ab" for k in range(5)], ddl).write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_history(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), 3)
    q = stream.writeStream.outputMode("update").format("memory").queryName("histories").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    got = {r["session_id"]: [m["content"] for m in r["history"]] for r in spark.table("histories").collect()}
    assert got == {"a": ["m2", "m3", "m4"], "b": ["m3", "m4"]}


def test_bm25_and_fusion(spark):
    chunks = spark.createDataFrame([("f", 1, "pdf", "toán lý"), ("f", 2, "docx", "toán toán hóa"), ("f", 3, "pdf", "văn")], "file_id string, chunk_index long, file_type string, document string")
    asked = spark.createDataFrame([(1, "toán"), (2, "của là")], "question_id long, question string")
    got = {r["chunk_index"]: r["bm25_score"] for r in lexical.lexical_hits(lexical.lexical_index(chunks), asked).collect()}
    assert got == {2: 0.578466, 1: 0.470004}
    ddl = "question_id long, file_id string, chunk_index long, rank int"
    semantic = spark.createDataFrame([(1, "f", i, i) for i in (1, 2, 3)], ddl)
    words = spark.createDataFrame([(1, "f", 2, 1), (1, "f", 4, 2)], ddl)
    got = [(r["chunk_index"], r["rrf_score"]) for r in fusion.rrf(semantic, words).orderBy("rank").collect()]
    assert got == [(2, 0.032523), (1, 0.016393), (4, 0.016129), (3, 0.015873)] or got == [(2, 0.032522), (1, 0.016393), (4, 0.016129), (3, 0.015873)]


def test_evidence_stops_at_the_first_that_is_too_long(spark):
    pieces = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate((4000, 4000, 3000, 10), 1)], "question_id long, rank int, piece string")
    row = evidence.packed(pieces).first()
    assert (row["pieces"], row["chars"]) == (2, 8000)


@SLOW
@given(st.lists(st.integers(0, 6000), min_size=1, max_size=8))
def test_evidence_stays_within_its_bound(spark, sizes):
    pieces = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(sizes)], "question_id long, rank int, piece string")
    assert all(r["chars"] <= 10_000 for r in evidence.packed(pieces).collect())


@SLOW
@given(st.lists(st.text("abc", max_size=9), max_size=20))
def test_packing_keeps_all_lines(spark, lines):
    row = spark.createDataFrame([("\n".join(lines),)], "t string").select(chunking.pack_lines(F.col("t"), 10).alias("p")).first()
    kept = [x for x in lines if x]
    assert "\n".join(row["p"]) == "\n".join(kept)
    assert all(len(p) <= 10 or "\n" not in p for p in row["p"])


def test_packing_golden(spark):
    row = spark.createDataFrame([("aaa\nbb\ncccc\nd",)], "t string").select(chunking.pack_lines(F.col("t"), 6).alias("p")).first()
    assert row["p"] == ["aaa\nbb", "cccc\nd"]


def test_flowing_chunks(spark):
    ddl = "file_id string, block_index int, block_type string, section string, text string"
    blocks = [("f", 0, "paragraph", "s", "one"), ("f", 1, "paragraph", "s", "two"), ("f", 2, "table", "s", "T"), ("f", 3, "paragraph", "II. X", "II. X"), ("f", 4, "paragraph", "II. X", "x" * 1393), ("f", 5, "paragraph", "II. X", "y"), ("f", 6, "paragraph", "s", ""), ("f", 7, "paragraph", "other", "z")]
    got = [(r["block_indexes"], r["text"][:5]) for r in chunking.flowing_chunks(spark.createDataFrame(blocks, ddl)).orderBy("n").collect()]
    assert got == [([0, 1], "one\nt"), ([2], "T"), ([3, 4], "II. X"), ([5], "y"), ([7], "z")]


def test_column_letters(spark):
    got = spark.createDataFrame([(c,) for c in (1, 26, 27, 52, 53, 702, 703, 16384)], "c int").select(chunking.column_letters(F.col("c")).alias("l")).collect()
    assert [r["l"] for r in got] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]


def test_lookup_ids_are_checked(spark):
    items = quality.catalogue(spark.createDataFrame([("a/x.pdf", 1)], "relative_path string, size_bytes long"))
    wanted = items.first()["id"]
    assert quality.catalogue_item(items, wanted).count() == 1
    with pytest.raises(ValueError):
        quality.catalogue_item(items, "../etc/passwd")
    with pytest.raises(ValueError):
        quality.require_rows(items.limit(0), "items")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    c = lambda t: f"<w:tc>{p(t)}</w:tc>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{p('I. Mở đầu')}{p('nội  dung')}{p(' ')}<w:tbl><w:tr>{c('a')}{c('')}{c('b')}</w:tr><w:tr>{c('')}</w:tr><w:tr>{c('c')}</w:tr></w:tbl></w:body></w:document>"})


def xlsx() -> bytes:
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {S}><sheetData><row r="1">{cell("A1", "Thứ")}{cell("AB1", "x")}</row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>5</v></c><c r="C2"/></row></sheetData><mergeCells><mergeCell ref="A1:B3"/></mergeCells></worksheet>'
    return zipped({
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="TKB" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>chung</t></si></sst>",
        "xl/worksheets/sheet1.xml": sheet,
    })


def test_office_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b" / "T.XLSX").write_bytes(xlsx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "~$a.docx").write_bytes(docx())
    (tmp_path / "n.txt").write_bytes(b"x")
    (tmp_path / "p.pdf").write_bytes(b"one\f\ftwo")
    files = office.discover(spark, str(tmp_path))
    assert [r["relative_path"] for r in office.listed(files).collect()] == ["a.docx", "b/T.XLSX", "bad.docx", "p.pdf"]
    rows = office.read_docx(files)
    got = [(r["block_index"], r["block_type"], r["text"], r["section"], r["table_number"]) for r in office.good(rows).orderBy("block_index").collect()]
    assert got == [(0, "paragraph", "I. Mở đầu", "I. Mở đầu", None), (1, "paragraph", "nội dung", "I. Mở đầu", None), (2, "table", "Dòng 1: Ô 1: a | Ô 3: b\nDòng 3: Ô 1: c", "I. Mở đầu", 1)]
    told = {r["source"]: r for r in office.file_manifest(files, rows).collect()}
    assert told["a.docx"]["blocks"] == 3 and told["a.docx"]["errors"] == []
    assert told["bad.docx"]["blocks"] == 0 and "BadZipFile" in told["bad.docx"]["errors"][0]
    assert sorted((r["row"], r["col"], r["value"]) for r in office.good(office.read_cells(files)).collect()) == [(1, 1, "Thứ"), (1, 28, "x"), (2, 1, "chung"), (2, 2, "5")]
    assert [tuple(r)[3:] for r in office.good(office.read_merged(files)).collect()] == [("TKB", 1, 1, 3, 2)]
    pages = office.good(office.read_pdf(files, lambda data: data.decode().split("\f"))).orderBy("page").collect()
    assert [(r["block_index"], r["page"], r["text"]) for r in pages] == [(0, 1, "one"), (1, 3, "two")]


def test_files_of_all_kinds_to_chunks(spark, tmp_path):
    for name, data in (("a.docx", docx()), ("t.xlsx", xlsx()), ("n.txt", b"x"), ("p.pdf", b"one\f\ftwo"), ("bad.xlsx", b"no zip")):
        (tmp_path / name).write_bytes(data)
    files = office.discover(spark, str(tmp_path), every=True)
    rows = office.read_files(files, lambda data: data.decode().split("\f"))
    told = {r["source"]: r for r in office.file_manifest(files, rows).collect()}
    assert told["n.txt"]["errors"] == ["ValueError: Unsupported file type: .txt"] and "BadZipFile" in told["bad.xlsx"]["errors"][0]
    assert [told[n]["blocks"] for n in ("a.docx", "t.xlsx", "p.pdf")] == [3, 2, 2]
    blocks = office.block_table(files, rows)
    made = chunking.build_chunks(blocks)
    got = {r["source"]: [] for r in made.collect()}
    for r in made.orderBy("source", "chunk_index").collect():
        got[r["source"]].append((r["chunk_index"], r["text"], [b[-6:] for b in r["block_ids"]], r["block_types"], r["location"]["section"], r["location"]["page"], r["location"]["row"]))
    assert got["a.docx"][0] == (0, "I. Mở đầu\nnội dung", ["b00000", "b00001"], ["paragraph"], "I. Mở đầu", None, None)
    assert got["a.docx"][1][3] == ["table"] and [x[5] for x in got["p.pdf"]] == [1, 3] and got["t.xlsx"][0][1] == "Trang tính: TKB\nDòng: 1\nA1=Thứ | AB1=x"
    assert {r["source"]: (r["blocks"], r["chunks"]) for r in chunking.build_manifest(blocks, made).collect()} == {"a.docx": (3, 2), "t.xlsx": (2, 2), "p.pdf": (2, 2), None: (7, 6)}
    tables.write_manifest(chunking.build_manifest(blocks, made), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    flat = {r["id"]: r for r in tables.flat_metadata(made).collect()}
    assert all(r["document"].startswith("Tên tài liệu: ") and r["table"] == "" for r in flat.values())
    own = chunking.build_chunks(blocks, spark.createDataFrame([(r["file_id"], "TKB", "2", "S", "10A1", "10", ["1"], 9, 9, "text", 1) for r in files.where("source = 't.xlsx'").collect()], "file_id string, sheet string, day string, session string, class_name string, grade string, periods array<string>, row_start int, row_end int, text string, n int"))
    row = own.where("file_type = 'xlsx'").first()
    assert (row["text"], row["block_ids"][0][-6:], row["location"]["row"], row["location"]["class_name"], row["location"]["periods"]) == ("text", "b00000", 1, "10A1", "1")


def test_cells_of_tables_and_sheets():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(f'<w:p><w:r><w:t>{t}</w:t></w:r></w:p>' for t in text.split('|'))}</w:tc>"
    nested = "<w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>outer</w:t></w:r></w:p></w:tc>"
    restart, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = f"<w:tr>{cell('a|b', '<w:gridSpan w:val=\"2\"/>')}{cell('c', restart)}</w:tr><w:tr>{cell('d')}{nested}{cell('', on)}</w:tr>"
    data = zipped({"word/document.xml": f"<w:document {W}><w:body><w:tbl>{rows}</w:tbl></w:body></w:document>"})
    assert [r[2] for r in office.docx_blocks(data)] == ["Dòng 1: Ô 1: a\nb | Ô 2: a\nb | Ô 3: c\nDòng 2: Ô 1: d | Ô 2: outer | Ô 3: c"]
    value = lambda raw, kind=None, dated=False: office.cell_value(kind, raw, ["x"], dated, False)
    assert [value("0", "s"), value("1", "b"), value("5"), value("5.50"), value("1e3"), value("45292", dated=True), value("45292.5", dated=True), value("0.25", dated=True), value("err", "e")] == ["x", "True", "5", "5.5", "1000.0", "2024-01-01 00:00:00", "2024-01-01 12:00:00", "06:00:00", "err"]


def test_streamed_context(spark, tmp_path):
    lessons = reshape.lessons_of(CELLS.frame(spark), MERGED.frame(spark))
    rows = turns(spark)
    want = {(r["session_id"], r["pos"]): tuple(r) for r in sessions.fold_sessions(rows, lessons).collect()}
    middle = rows.agg(F.percentile_approx("pos", 0.5)).first()[0]
    for k, part in enumerate((F.col("pos") <= middle, F.col("pos") > middle)):  # the second trigger goes on from the state
        rows.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
        os.utime(next((tmp_path / "in" / f"k={k}").glob("*.parquet")), (1000 + k, 1000 + k))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = sessions.stream_context(source, lessons).writeStream.outputMode("append").format("memory").queryName("contexts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    assert {(r["session_id"], r["pos"]): tuple(r) for r in spark.table("contexts").collect()} == want
    assert any(n for _, _, ok, n, *_ in want.values() if ok)


def test_silent_sessions_are_forgotten(spark, tmp_path):
    ddl = "session_id string, pos int, role string, content string"
    write = lambda k: spark.createDataFrame([("a", k, "user", f"m{k}")], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(0)
    stream = sessions.stream_history(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), 3, idle_ms=2000)
    q = stream.writeStream.outputMode("update").format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        shown = lambda: {tuple(m["content"] for m in r["history"]) for r in spark.table("silent").collect()}
        wait = lambda told: next((True for _ in range(120) if told in shown() or time.sleep(0.25)), False)
        assert wait(("m0",))
        time.sleep(6)
        write(1)
        assert wait(("m1",)) and ("m0", "m1") not in shown()
    finally:
        q.stop()


def test_answers_and_what_is_remembered(spark):
    lessons = reshape.lessons_of(CELLS.frame(spark), MERGED.frame(spark)).withColumn("pos", F.monotonically_increasing_id())
    asked = spark.createDataFrame([(1, "lớp 10A1 thứ 2 buổi sáng tiết 1"), (2, "lớp 10A1 thứ 7 buổi sáng tiết 1"), (3, "tkb thứ 2"), (4, "tkb lớp 12A4"), (5, "ai?"), (6, "lớp 10A1 thứ 2 học gì"), (7, "tkb lớp 10A1 thứ 3 sáng chiều")], "question_id long, question string")
    rows = spark.createDataFrame([(5, 1, "nguồn", "văn bản")], "question_id long, rank int, source string, document string")
    got = {r["question_id"]: r for r in answering.answer_batch(asked, lessons, lambda q: rows.join(q, "question_id", "left_semi")).collect()}
    assert got[1]["answer"] == "Lớp 10A1, Thứ Hai, Sáng, tiết 1: Toán-An." and got[1]["sources"][0]["source"] == "TKB trực tiếp từ Excel"
    assert got[2]["answer"] == "Dữ liệu TKB hiện tại không có bản ghi cho lớp 10A1, Thứ Bảy, Sáng, tiết 1."
    assert (got[3]["answer"], got[4]["answer"], got[6]["answer"]) == (answering.NO_CLASS, answering.NOTHING_FOUND, answering.TOO_LITTLE)
    assert got[7]["answer"].endswith("\n\nLưu ý: dữ liệu TKB hiện tại không có tiết chiều cho lớp 10A1.")
    assert got[5]["mode"] == "documents" and "văn bản" in got[5]["answer"] and got[5]["sources"][0]["source"] == "nguồn"
    follow = spark.createDataFrame([(1, "còn buổi sáng thì sao", ("10A1", None, ["2"], []))], "question_id long, question string, context struct<class_name:string,grade:string,days:array<string>,sessions:array<string>>")
    assert "10A1" in answering.answer_batch(follow, lessons, lambda q: rows.join(q, "question_id", "left_semi")).first()["answer"]
    done = spark.createDataFrame([("s", 3, "q", "e", "a"), ("s", 4, "q", "e", "")], "session_id string, turn int, question string, evidence string, answer string")
    left = answering.remembered(done).orderBy("pos").collect()
    assert [(r["pos"], r["role"], r["content"][-3:]) for r in left] == [(6, "user", ":\ne"), (7, "assistant", "a")]
    told = answering.answered_by(spark.createDataFrame([("x",)], "evidence string"), lambda texts: texts + "!").first()
    assert told["reply"] == "x!"
    past = F.array(F.struct(F.lit("user").alias("role"), F.lit("h").alias("content")))
    asked_now = spark.range(1).select(evidence.prompt_messages("sys", past, F.lit("q"), F.lit("e")).alias("m")).first()["m"]
    assert [m["role"] for m in asked_now] == ["system", "user", "user"] and asked_now[2]["content"] == "Câu hỏi: q\n\nBằng chứng:\ne"


def test_stored_index_equals_plans(spark, tmp_path):
    rows = [("f", i, "pdf" if i % 2 else "xlsx", f"toán lý {'hóa ' * (i % 5)} w{i}", f"nguồn{i % 3}", None if i % 2 else "II. Mục") for i in range(40)]
    chunks = spark.createDataFrame(rows, "file_id string, chunk_index long, file_type string, document string, source string, section string")
    asked = spark.createDataFrame([(1, "toán hóa"), (2, "nguồn1 w7"), (3, "mục")], "question_id long, question string")
    lexical.write_index(chunks, str(tmp_path / "i"), lexical.section_text())
    stored = lexical.read_index(spark, str(tmp_path / "i"))
    for kinds in ((), ("pdf",)):
        a, b = stored, lexical.lexical_index(chunks, lexical.section_text())
        a, b = (a.of(*kinds), b.of(*kinds)) if kinds else (a, b)
        one, two = ([tuple(r) for r in lexical.lexical_hits(x, asked).orderBy("question_id", "rank").collect()] for x in (a, b))
        assert one == two and len(one) > 20
    some = spark.createDataFrame([(1, "f", 4), (3, "f", 4), (3, "f", 5)], "question_id long, file_id string, chunk_index long")
    every = {(r["question_id"], r["chunk_index"]): r["bm25_score"] for r in lexical.bm25(stored, asked).collect()}
    assert {(r["question_id"], r["chunk_index"]): r["bm25_score"] for r in lexical.bm25(stored, asked, some).collect()} == {k: v for k, v in every.items() if k in {(1, 4), (3, 4), (3, 5)}}
    assert search.by_batches(asked, lambda part: part, most=1).count() == 3
    plan = lexical.bm25(stored, asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_approximate_hits_find_what_is_near(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [("f", i, "pdf", f"d{i}", (centres[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(400)] + [("f", 900, "pdf", "zero", [0.0] * 16), ("f", 901, "xlsx", "other", centres[0].tolist())]
    vectors = spark.createDataFrame(rows, "file_id string, chunk_index long, file_type string, document string, embedding array<double>")
    asked = spark.createDataFrame([(k, centres[k].tolist()) for k in range(5)], "question_id long, vector array<double>")
    exact = {(r["question_id"], r["chunk_index"]): r["semantic_score"] for r in search.semantic_hits(vectors, asked, 10).collect()}
    got = {(r["question_id"], r["chunk_index"]): r["semantic_score"] for r in search.approximate_hits(vectors, asked, 10).collect()}
    assert len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(s - exact[k]) < 1e-5 for k, s in got.items() if k in exact)


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Thứ"), ("b", None)], "k string, v string")
    tables.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "j"), "k string, v string").collect())) == [("a", "Thứ"), ("b", None)]
    vectors = tables.embedded(spark.createDataFrame([("f", "pdf", "x y"), ("g", "xlsx", None)], "file_id string, file_type string, document string"))
    tables.write_vectors(vectors, str(tmp_path / "v"))
    tables.write_vectors(vectors, str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")).count() == 2
    one = tables.read_vectors(spark, str(tmp_path / "v"), "f").first()
    assert abs(sum(x * x for x in one["embedding"]) - 1) < 1e-6


def test_plans_are_what_they_should_be(spark):
    chunks = spark.range(2000).selectExpr("'f' as file_id", "id as chunk_index", "'pdf' as file_type", "'d' as document", "array(cast(id as float), 1f) as embedding")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<double>")
    plan = search.semantic_hits(chunks, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan
    lessons = spark.range(10).selectExpr("'s' as source", "'t' as sheet", "'10A1' as class_name", "'10' as grade", "'2' as day", "'S' as session", "1 as period", "'v' as value", "'' as ambiguity", "id as pos")
    parsed = timetable.parsed_questions(spark.createDataFrame([(1, "lớp 10A1 thứ 2 buổi sáng tiết 1")], "question_id int, question string"))
    assert timetable.answer_questions(lessons, parsed).first()["n_rows"] == 1
