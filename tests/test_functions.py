import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenbase.functions import question as P
from lumenbase.functions import text as T

SLOW = settings(deadline=None, max_examples=5, suppress_health_check=[HealthCheck.function_scoped_fixture])
LINES = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=12)


def run(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r["o"] for r in rows.select("n", f(F.col("v")).alias("o")).orderBy("n").collect()]


def test_search_words(spark):
    got = run(spark, T.tokens, ["Hiệu trưởng của trường là ai?", "Hội thi Xuân’s Got Talent", "", "a b c"])
    assert got == [["hiệu", "trưởng"], ["hội", "thi", "xuân", "got", "talent"], [], []]


def test_subjects(spark):
    assert run(spark, T.format_subject, ["A - Thầy B;  C - Cô D[P2]", "[TRỐNG];x", None, ";"]) == ["A - Thầy B / C - Cô D [P2]", "[TRỐNG] / x", "", ""]
    got = run(spark, T.split_assignments, ["A - Thầy B; HĐTN-Loan", ""])
    assert [[tuple(p) for p in x] for x in got] == [[("A", "Thầy B"), ("HĐTN-Loan", "")], []]


def test_days_and_sessions(spark):
    assert run(spark, T.sheet_day, ["Thứ 2", "thứ tư", "thu bay", "hai"]) == ["2", "4", "3", "hai"]
    assert run(spark, T.day_code, ["Thứ 2", "hai", "7", "8"]) == [None, "2", "7", None]
    assert run(spark, T.sheet_session, ["S", "sáng", "CHIỀU", "x "]) == ["S", "S", "C", "x"]
    assert run(spark, T.sessions_in, ["s", "C", "sáng và chiều", "xsáng"]) == [["S"], ["C"], ["S", "C"], []]


def test_unicode_white_space(spark):
    assert run(spark, T.clean_cell, [" a  b ", None]) == ["a b", ""]
    assert run(spark, T.nfc, ["é", None]) == ["é", None]


def test_headings_and_replies(spark):
    assert run(spark, T.is_heading, ["II. Mục", "c) ý", "d) ý"]) == [True, True, False]
    assert run(spark, T.reply_text, ["<think>x</think> ok", "a<think>b", " z "]) == ["ok", "a", "z"]


@SLOW
@given(LINES)
def test_cleaning_twice_changes_nothing(spark, lines):
    once = run(spark, T.clean_text, ["\n".join(lines)])
    assert run(spark, T.clean_text, once) == once


@SLOW
@given(st.lists(st.text(" ;ab-", max_size=20), min_size=1, max_size=8))
def test_subjects_twice_change_nothing(spark, values):
    once = run(spark, T.format_subject, values)
    assert run(spark, T.format_subject, once) == once


GOLDEN = [
    ("Thứ 2 buổi sáng lớp 10A1 có những môn nào?", "10A1", None, ["2"], ["S"], [], "timetable"),
    ("lớp 10A1 có 5 tiết buổi sáng thứ 4", "10A1", None, ["4"], ["S"], [1, 2, 3, 4, 5], "timetable"),
    ("tkb khối 11 thứ bảy", None, "11", ["7"], [], [], "timetable"),
    ("tiết 5-2 lớp 6A1", "6A1", None, [], [], [5], "lookup"),
    ("tiết 19 đến 25", None, None, [], [], [19], "lookup"),
    ("tiết 0", None, None, [], [], [], "lookup"),
    ("thứ 5 đến thứ 2", None, None, ["2", "5"], [], [], "timetable"),
    ("thứ tu - thứ nam", None, None, ["4", "5"], [], [], "timetable"),
    ("thứ tu", None, None, [], [], [], "lookup"),
    (None, None, None, [], [], [], "lookup"),
    ("có 99999999999 tiết", None, None, [], [], [], "lookup"),
]


def test_questions(spark):
    got = run(spark, P.parse_engine, [g[0] for g in GOLDEN])
    for g, q in zip(GOLDEN, got, strict=True):
        assert (q["class_name"], q["grade"], q["days"], q["sessions"], q["periods"], q["mode"]) == g[1:], g[0]


def test_dialects_differ(spark):
    texts = ["tiết 4 và 5 lớp 7A1", "tiết 1-3 lớp 6A2", "tiết 1 đến 3 lớp 6A2", "thứ 2 - thứ 5", "lớp 10A1 sáng chiều"]
    one, four = run(spark, P.parse_chunk_v1, texts), run(spark, P.parse_chunk_v4, texts)
    assert [q["periods"] for q in one] == [["4", "5"], ["1"], ["1"], [], []]
    assert [q["periods"] for q in four] == [["4", "5"], ["1"], ["1", "2", "3"], [], []]
    assert [q["day"] for q in one][3] == "2" and four[3]["days"] == ["2", "5"]
    assert (one[4]["session"], four[4]["session"], one[4]["grade"]) == ("S", "S", "10")
    with pytest.raises(KeyError):
        P.parse_question(F.lit("x"), "other")


def test_follow_ups_inherit(spark):
    ddl = "n int, v string, c struct<class_name:string,grade:string,days:array<string>,sessions:array<string>>"
    known = ("10A1", None, ["2"], ["S"])
    rows = spark.createDataFrame([(1, "còn tiết 3 thì sao", known), (2, "còn buổi chiều?", known), (3, "thế còn thứ 3 thì sao", known), (4, "tiết 3", None), (5, "tkb tiết 3", known)], ddl)
    got = [r["q"] for r in rows.select("n", P.parse_engine(F.col("v"), F.col("c")).alias("q")).orderBy("n").collect()]
    assert [(q["class_name"], q["days"], q["sessions"], q["periods"]) for q in got] == [("10A1", ["2"], ["S"], [3]), ("10A1", ["2"], ["C"], []), (None, ["3"], [], []), (None, [], [], [3]), (None, [], [], [3])]


@pytest.mark.parametrize("dialect", ["engine", "chunk_v4"])
def test_each_pattern_is_sought_once_a_row(spark, dialect):
    rows = P.with_parsed(spark.createDataFrame([(1, "lớp 10A1 thứ hai đến thứ tư tiết 1-3 buổi sáng"), (2, None)], "n int, question string"), dialect).select("n", "q.*")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in (r"A\d+)\b", "toàn bộ")] == [1, 1]
    got = {r["n"]: r for r in rows.collect()}
    assert got[1]["class_name"] == "10A1" and got[1]["days"] == ["2", "3", "4"] and got[2]["days"] == []
    assert got[1]["periods"] == ([1, 2, 3] if dialect == "engine" else ["1"])  # the other dialect's text has no dash
