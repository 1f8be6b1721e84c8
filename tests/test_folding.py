"""Sessions are folded many to a batch."""

from lumenbase.streaming import sessions


def test_sessions_of_a_batch_keep_apart(spark):
    """Sessions share the slots that were read for a batch, but no context; no group of its own is made for each."""
    lessons = spark.createDataFrame([("10A1", "10", "2", "S", 1), ("10A1", "10", "2", "S", 2), ("11A2", "11", "3", "C", 1)], "class_name string, grade string, day string, session string, period int")
    ddl = "session_id string, pos int, is_reset boolean, follows boolean, timetable_word boolean, class_name string, grade string, days array<string>, sessions array<string>, periods array<int>"
    rows = [(s, *turn) for s in ("a", "b", None) for turn in ((2, False, True, False, None, None, [], [], [2]), (1, False, False, True, "10A1", None, ["2"], ["S"], []), (3, True, False, False, None, None, [], [], []))]
    rows += [("c", 1, False, True, False, None, None, [], [], [2]), ("d", 1, False, False, True, None, "11", [], [], []), ("e", 1, False, False, True, "9A9", None, [], [], [])]
    folded = sessions.fold_sessions(spark.createDataFrame(rows, ddl).coalesce(1), lessons)
    got = sorted(map(tuple, folded.collect()), key=str)
    whole = [(1, True, 2, "10A1", None, "2", "S", None), (2, True, 1, "10A1", None, "2", "S", 2), (3, False, 0, None, None, None, None, None)]
    want = [(s, *r) for s in ("a", "b", None) for r in whole] + [("c", 1, False, 0, *[None] * 5), ("d", 1, True, 1, None, "11", None, None, None), ("e", 1, False, 0, *[None] * 5)]
    assert got == sorted(want, key=str)
    assert "CoGroup" not in folded._jdf.queryExecution().toString()
