import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest

from lumenbase.llm.conversations import CHUNK, GONE, INITIALS, SOUND, TRUNCATED, cheapest, repair
from lumenbase.llm.queries import ORACLE_SQL, op12_conversation_repair

DDL = "conv_id long, turn long, role string, text string, cost long"


def cheapest_by_force(rows):
    """The least (cost, audit) over the whole lattice, one row after the other; rows: (initial, kind)."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    def spread(states):
        for _ in range(3):
            for last, (cost, audit) in list(states.items()):
                to = follows[last]
                states[to] = min(states.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return states

    states = spread({"": (0, "")})
    for initial, kind in rows:
        new = {}
        for last, (cost, audit) in states.items():
            ways = [(last, 3, "D")]
            if kind != GONE:
                ways.append((follows[last], 2 + kind, "R"))
                if initial == follows[last] or (initial, last) == ("s", ""):
                    ways.append((initial, kind, "K"))
            for to, more, letter in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost + more, audit + letter))
        states = spread(new)
    return min(v for k, v in states.items() if k in ("", "a"))


def every_edit(rows, most):
    """All edit sequences of at most `most` inserts at a place, spelled out; the least (cost, audit)."""
    best = None
    for inserts in itertools.product(range(most + 1), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            roles, cost, audit, good = "", 0, "", True
            for k in range(len(rows) + 1):
                for _ in range(inserts[k]):
                    roles, cost, audit = roles + ("u" if roles[-1:] != "u" else "a"), cost + 2, audit + "I"
                if k < len(rows):
                    (initial, kind), edit = rows[k], edits[k]
                    good &= edit == "D" or kind != GONE
                    cost += {"D": 3, "K": kind, "R": 2 + kind}[edit]
                    roles += {"D": "", "K": initial, "R": "u" if roles[-1:] != "u" else "a"}[edit]
                    audit += edit
            if good and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def coded(rows):
    return bytes(4 * kind + INITIALS.index(initial) for initial, kind in rows)


def test_search_equals_all_edit_sequences():
    rng = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(25):
            rows = [(rng.choice("?ssuuuaaa"), rng.choice((SOUND, SOUND, TRUNCATED, GONE))) for _ in range(n)]
            assert cheapest(coded(rows)) == every_edit(rows, 2) == cheapest_by_force(rows)


def test_search_equals_the_whole_lattice():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("?suuuuaaaa"), rng.choice((SOUND, SOUND, SOUND, TRUNCATED, GONE))) for _ in range(rng.randrange(60))]
        assert cheapest(coded(rows)) == cheapest_by_force(rows)
    long = [("ua"[k % 2], SOUND) for k in range(2 * CHUNK + 7)]
    assert cheapest(coded(long)) == cheapest_by_force(long)
    for k in rng.sample(range(len(long)), 300):
        long[k] = rng.choice("sua"), rng.choice((SOUND, TRUNCATED, GONE))
    assert cheapest(coded(long)) == cheapest_by_force(long)


def repaired_by_force(rows):
    """The contract, said plainly: conv_id -> result."""
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        counts, kinds, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in after:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "" if letters[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append(((role[:1] if role[:1] in "sua" else "?") or "?", {"": SOUND, "truncated": TRUNCATED}.get(fault, GONE)))
        cost, audit = cheapest_by_force(kinds)
        turns = {r[0] for r in after if r[0] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        lines, last, at = [], "", 0
        for letter in audit:
            to = "u" if last != "u" else "a"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[to])
                last = to
                continue
            _, role, text = after[at]
            at += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                last = role[0]
            if letter == "R":
                lines.append({"u": "user:", "a": "assistant:"}[to] + text)
                last = to
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made():
    rng = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            rows.append((conv, turn * rng.choice((1, 1, 2)), role, rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \t", None, "é…", f"row {turn}.\n", "one. "])))
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"text {t % 40}.") for t in range(900)]  # a hot conversation
    rows += [(201, None, "user", "a."), (201, None, "assistant", "b."), (201, 7, "user", "a."), (202, None, None, None), (203, 3, "user", "x." * 200_000), (None, 1, "user", "nobody.")]
    rows += [(204, 1, "user", "same."), (204, 1, "user", "same."), (204, 1, "assistant", "same."), (204, 1, "assistant", "other.")]
    return rows


def test_repair_equals_the_contract(spark):
    rows = made()
    got = repair(spark.createDataFrame([(*r, 1) for r in rows], DDL).repartition(5)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == repaired_by_force(rows) and len(got) == len({r["conv_id"] for r in got})


def test_conversation_of_which_nothing_is_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair(spark.createDataFrame([(conv, 0, "user", "Hi.", 1)], DDL)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair(spark.createDataFrame([], DDL)).collect() == []


def test_undamaged_rows_and_other_names(spark):
    rows = spark.createDataFrame([("4", "0", "system", "Be kind."), ("4", "1", "user", "Hi."), ("4", "2", "assistant", "Hello.")], "c string, t string, audit string, summary string")
    got = repair(rows, damage=False, conv_col="c", turn_col="t", role_col="audit", text_col="summary").collect()
    assert [tuple(r)[:8] for r in got] == [(4, 0, 0, 0, 0, 0, 0, "KKK")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op12_conversation_repair(spark, sf).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op12_conversation_repair"])
    assert want.columns == got[0].__fields__
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
