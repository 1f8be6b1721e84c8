"""Session state: bounded history, resets, and the context that follow-up questions inherit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

HISTORY = 12
CONTEXT = ("class_name", "grade", "days", "sessions", "periods")
CONTEXT_DDL = "class_name string, grade string, day string, session string, period int"


def recent(messages: DataFrame, most: int | None = HISTORY, by: str = "session_id", order: str = "pos") -> DataFrame:
    """The last `most` messages of each session; None keeps all."""
    if most is None:
        return messages
    back = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("n", F.row_number().over(back)).where(F.col("n") <= most).drop("n")


def segments(messages: DataFrame, is_reset: Column, by: str = "session_id", order: str = "pos") -> DataFrame:
    """With `segment`: how many resets came up to a message, itself included; state doesn't reach over a segment's start."""
    sofar = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("segment", F.sum(F.when(is_reset, 1).otherwise(0)).over(sofar))


def history(messages: DataFrame, by: str = "session_id", order: str = "pos") -> DataFrame:
    """session_id and its messages as an array of (role, content), in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", "content")))
    return messages.groupBy(by).agg(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("history"))


def next_context(context: dict, said: dict) -> dict:
    """The context after an answered question: class and grade replace what was; of a list, one value is stored, several
    clear it, none leaves it."""
    out = dict(context)
    for k in ("class_name", "grade"):
        if said.get(k):
            out[k] = said[k]
    for k in ("days", "sessions", "periods"):
        values = list(said.get(k) if said.get(k) is not None else ())
        if len(values) == 1:
            out[k] = values[0]
        elif values:
            out.pop(k, None)
    return out


FOLDED = f"session_id string, pos int, ok boolean, n_rows int, {CONTEXT_DDL}"


def inherited(said: dict, context: dict) -> dict:
    """What a follow-up question asks for, field by field; periods are its own."""
    out = dict(said)
    for k in ("class_name", "grade"):
        out[k] = said.get(k) or context.get(k)
    for k in ("days", "sessions"):
        values = said.get(k)
        out[k] = list(values) if values is not None and len(values) else ([context[k]] if k in context else [])
    return out


def answered(asked: dict, slots: dict[str, list[tuple]]) -> int:
    """The number of facts that an effective predicate finds; 0 where it can't be answered. slots: (day, session, period, number
    of facts) of a class, and of a grade, by its name."""
    days, sessions, periods = (list(asked.get(k) if asked.get(k) is not None else ()) for k in ("days", "sessions", "periods"))
    named = asked.get("class_name") or asked.get("grade")
    if not named:
        return 0
    hits = sum(n for d, s, p, n in slots.get(named, ()) if (not days or d in days) and (not sessions or s in sessions) and (not periods or p in periods))
    several = any(len(x) > 1 for x in (days, sessions, periods))
    if asked["timetable_word"] or several or (asked.get("class_name") and not periods and bool(days) == bool(sessions)):
        return hits
    return hits if asked.get("class_name") and days and sessions and periods else 0


def fold(rows: pd.DataFrame, context: dict, slots: dict[str, list[tuple]]) -> Iterator[tuple]:
    """folded() of a frame's rows."""
    return folded(rows.sort_values("pos").to_dict("records"), context, slots)


def folded(turns: list[dict], context: dict, slots: dict[str, list[tuple]]) -> Iterator[tuple]:
    """Turns in order: a reset clears the context; a question inherits, is answered, and on success changes the context."""
    for r in turns:
        if r["is_reset"]:
            context.clear()
            found = 0
        else:
            said = {k: r[k] for k in (*CONTEXT, "timetable_word")}
            asked = inherited(said, context) if r["follows"] else said
            found = answered(asked, slots)
            if found:
                changed = next_context(context, asked)
                context.clear()
                context.update(changed)
        yield (r["session_id"], int(r["pos"]), found > 0, found, *[context.get(k) for k in CONTEXT])


FOLDED_COLUMNS = [part.split()[0] for part in FOLDED.split(", ")]
FOLDED_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[part.split()[1]] for part in FOLDED.split(", ")]
TURN = ("pos", "is_reset", "follows", "timetable_word", *CONTEXT)


def counted_slots(lessons: DataFrame) -> DataFrame:
    """name, d, s, p, n: of each class and each grade, how many facts a day, session and period have. A name has no more rows
    than a week has periods."""
    slots = lessons.select("class_name", "grade", F.col("day").alias("d"), F.col("session").alias("s"), F.col("period").alias("p")).distinct()
    named = slots.select(F.explode(F.array("class_name", "grade")).alias("name"), "d", "s", "p").where("name is not null")
    return named.groupBy("name", "d", "s", "p").agg(F.count(F.lit(1)).alias("n"))


def named_slots(lessons: DataFrame) -> DataFrame:
    """name and its counted slots, as an array."""
    return counted_slots(lessons).groupBy("name").agg(F.collect_list(F.struct(*"dspn")).alias("slots"))


def slots_of(turns: DataFrame, lessons: DataFrame) -> DataFrame:
    """session_id and, as an array, the names and counted slots of every class and grade that the session says and the timetable
    has. A context holds only what its session said, so no turn can ask for others."""
    named = turns.select("session_id", F.explode(F.array("class_name", "grade")).alias("name")).where("name is not null").distinct()
    return named.join(named_slots(lessons), "name").groupBy("session_id").agg(F.collect_list(F.struct("name", "slots")).alias("told"))


def fold_sessions(turns: DataFrame, lessons: DataFrame) -> DataFrame:
    """One row a turn with the context after it. turns: session_id, pos, is_reset, follows, timetable_word and the parsed
    fields; lessons: class_name, grade, day, session, period. Whether a turn succeeds decides what the next one inherits,
    so a session is folded in order, as one row with its turns and the slots that its classes and grades have; many sessions come
    in a batch, for which a name's slots are read once."""
    said = F.array_sort(F.collect_list(F.struct("pos", *(c for c in TURN if c != "pos"))))
    rows = turns.groupBy(F.col("session_id").alias("of")).agg(said.alias("turns"))
    rows = rows.join(slots_of(turns, lessons), F.col("of").eqNullSafe(F.col("session_id")), "left").select(F.col("of").alias("session_id"), "turns", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = b.column("told").flatten()
            first = {}
            for i, name in enumerate(told.field("name").to_pylist()):
                first.setdefault(name, i)
            slots = {name: [tuple(x.values()) for x in told.field("slots")[i].as_py()] for name, i in first.items()}
            out = []
            for session, said in zip(b.column("session_id").to_pylist(), b.column("turns"), strict=True):
                out += folded([{"session_id": session} | turn for turn in said.as_py()], {}, slots)
            columns = zip(*out, strict=True) if out else [[] for _ in FOLDED_COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, FOLDED_TYPES, strict=True)], names=FOLDED_COLUMNS)

    return rows.mapInArrow(run, FOLDED)


MESSAGE = "pos int, role string, content string"
NO_PERIOD = -1  # stands in the state for a slot without a period; no question asks for it


class Remembering(StatefulProcessor):
    """What both streams share: with `idle_ms`, the state of a session that has been silent for so long is cleared."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def awaited(self, timers) -> None:
        """Moves the session's timer to the end of its time from now on."""
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class ContextOf(Remembering):
    """A session's context, and the counted slots of the names that it has said."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", CONTEXT_DDL)
        self.slots = handle.getMapState("slots", "name string", "d array<string>, s array<string>, p array<int>, n array<long>")

    def clear(self) -> None:
        self.context.clear()
        self.slots.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows))
        held = self.context.get() if self.context.exists() else None
        context = {k: v for k, v in zip(CONTEXT, held or (), strict=False) if v is not None}
        for x in (x for told in turns["told"] for x in told):
            self.slots.updateValue((x["name"],), tuple(np.asarray(x[c]).tolist() for c in "dspn"))
        by_name = {name: list(zip(*slots, strict=True)) for (name,), slots in self.slots.iterator()}
        out = list(fold(turns, context, by_name))
        self.context.update(tuple(context.get(k) for k in CONTEXT))
        self.awaited(timerValues)
        yield pd.DataFrame(out, columns=FOLDED_COLUMNS).astype({"period": "Int32"})


class HistoryOf(Remembering):
    """The last messages of a session, as a list."""

    def __init__(self, most: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("history", MESSAGE)

    def clear(self) -> None:
        self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        reset = -1
        for new in rows:
            if "is_reset" in new.columns and new["is_reset"].any():
                reset = max(reset, int(new.loc[new["is_reset"], "pos"].max()))
            both = old + [(int(r.pos), r.role, r.content) for r in new.itertuples()]
            old = sorted(x for x in both if x[0] > reset)[-self.most :]
        self.held.clear()
        if old:
            self.held.put(old)
        self.awaited(timerValues)
        yield pd.DataFrame({"session_id": [key[0]], "history": [[{"pos": p, "role": r, "content": c} for p, r, c in old]]})


def stream_context(turns: DataFrame, lessons: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of turns, as fold_sessions takes them, to a row a turn with the context after it; a reset clears it. A trigger's
    turns are folded in order of pos onto the session's state. A turn that names a class or grade brings its counted slots along,
    by a join of the stream with the timetable, and the session keeps them for the turns that inherit the name. Needs the RocksDB
    state store. With `idle_ms`, silent sessions are forgotten; such a stream runs on by itself, for it must look at the clock."""
    slots = counted_slots(lessons).withColumn("p", F.coalesce("p", F.lit(NO_PERIOD)))
    by_name = slots.groupBy("name").agg(F.collect_list(F.struct(*"dspn")).alias("x")).select("name", *(f"x.{c}" for c in "dspn"))
    told = turns
    for c in ("class_name", "grade"):
        slots = by_name.select(F.col("name").alias(f"{c}_named"), F.struct("name", *"dspn").alias(f"{c}_slots"))
        told = told.join(slots, F.col(c) == F.col(f"{c}_named"), "left").drop(f"{c}_named")
    told = told.withColumn("told", F.array_compact(F.array("class_name_slots", "grade_slots"))).drop("class_name_slots", "grade_slots")
    return told.groupBy("session_id").transformWithStateInPandas(ContextOf(idle_ms), FOLDED, "Append", "ProcessingTime" if idle_ms else "None")


def stream_history(messages: DataFrame, most: int = HISTORY, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, pos, role, content) to (session_id, history): after each trigger the last `most` messages
    of each session that got one. If the stream has a column is_reset, such a row empties the session's history of what came
    before it. `idle_ms` and the state store: as for stream_context."""
    return messages.groupBy("session_id").transformWithStateInPandas(HistoryOf(most, idle_ms), f"session_id string, history array<struct<{MESSAGE}>>", "Update", "ProcessingTime" if idle_ms else "None")
