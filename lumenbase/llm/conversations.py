"""Conversation structure repair: the cheapest edits that make a conversation an optional system row and then pairs of user
and assistant, found by A* on the edit lattice.

A node of the lattice is (rows dealt with, role last given). Keep costs 0, Rerole to the role that must come next 2, Delete
3, Insert of an empty row with that role 2; a truncated row that stays adds 1, and a blank row or a duplicate must be deleted.
The heuristic is the suffix sum of what no path avoids: 3 for each row that must go, 1 for each truncated one. It never falls
by more than an edit costs, so the first time that a node leaves the heap, keyed (cost + heuristic, audit), its cost is least
and its audit the ASCII-least of that cost.

The search needs one byte of each row: rows without their texts are sorted within partitions of conv_id and read as a stream,
and the search holds that byte a row, as large as the audit that it returns. Texts are moved once, sorted behind the
summary of their conversation, and hashed as they pass, so that a conversation of any length is held by no task.

Defined results: a null role or text is one space, as is a null turn in the damage's key; rows with a null conv_id have no
conversation and are left out; null turns come first; rows of one turn are ordered by role and then the SHA-256 of their
text, equal rows adjacent, the later ones duplicates; a role without a letter to begin with, or with another one than s, u or
a, can't be kept; a conversation without rows gives zeros, an empty audit and the hash of the empty string."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.llm.common import batch_of, bound_batches

WHITE = " \t\n\x0b\f\r"
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
STATES = {"": 0, "s": 1, "u": 2, "a": 3}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
CHUNK = 4096
#: What a row's byte says beside the initial of its role: sound, truncated, or one that must go.
SOUND, TRUNCATED, GONE = 0, 1, 2
INITIALS = "?sua"

SUMMARY_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
RESULT = SUMMARY.append(pa.field("repaired_sha256", pa.string()))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` decides, and `dropped` for rows that it takes."""
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"), copies).drop("copy")


def undamaged(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def row_code(text: Column, role: Column) -> Column:
    """(the row's end is missing, the row is blank, the place of the role's initial in INITIALS)."""
    end = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    first = F.left(role, F.lit(1))
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return F.struct((~end.isin(".", "!", "?")).alias("open"), (end == "").alias("blank"), initial.alias("initial"))


@lru_cache(1 << 14)
def short_repair(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the ASCII-least audit among them. A code is 4 * what the row is + its initial.

    An audit in the heap is a tuple of chunks of CHUNK letters and a shorter rest, so that long ones share their chunks; they
    compare as the joined strings do."""
    n = len(codes)
    least = array("q", bytes(8 * (n + 1)))
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (0, 1, 3)[codes[i] >> 2]
    done = bytearray(4 * (n + 1))
    heap = [(least[0], ("",), 0, "")]
    while heap:
        f, audit, i, last = heapq.heappop(heap)
        if done[4 * i + STATES[last]]:
            continue
        done[4 * i + STATES[last]] = 1
        if i == n and last in ("", "a"):
            return f, "".join(audit)
        spent, due = f - least[i], FOLLOWS[last]
        edits = [("I", 2, i, due)]
        if i < n:
            kind, initial = codes[i] >> 2, INITIALS[codes[i] & 3]
            edits.append(("D", 3, i + 1, last))
            if kind != GONE:
                if initial == due or initial == "s" and not last:
                    edits.append(("K", kind, i + 1, initial))
                if initial != due:
                    edits.append(("R", 2 + kind, i + 1, due))
        for letter, cost, to, role in edits:
            if not done[4 * to + STATES[role]]:
                rest = audit[-1] + letter
                heapq.heappush(heap, (spent + cost + least[to], (*audit[:-1], rest, "") if len(rest) == CHUNK else (*audit[:-1], rest), to, role))
    raise AssertionError("inserts complete every path")


class Conversation:
    """What a stream of a conversation's rows adds up to."""

    def __init__(self, conv_id: int):
        self.conv_id, self.codes = conv_id, bytearray()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, code: dict, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        kind = GONE if code["blank"] or again else TRUNCATED if code["open"] else SOUND
        self.blank += code["blank"]
        self.duplicate += again and not code["blank"]
        self.truncated += kind == TRUNCATED
        if self.codes:
            self.illegal += INITIALS[self.codes[-1] & 3] + INITIALS[code["initial"]] not in LEGAL
        self.codes.append(4 * kind + code["initial"])

    def summary(self) -> tuple:
        codes = bytes(self.codes)
        cost, audit = short_repair(codes) if len(codes) <= 64 else cheapest(codes)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += len(row[7])
        if len(held) == size or letters > 1 << 22:
            yield batch_of(schema, list(zip(*held, strict=True)))
            held, letters = [], 0
    if held:
        yield batch_of(schema, list(zip(*held, strict=True)))


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries from rows (conv_id, turn, code, again, dropped) in order."""

    def summaries():
        now = None
        for b in batches:
            for conv_id, turn, code, again, dropped in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now.summary()
                    now = Conversation(conv_id)
                if not dropped:
                    now.add(turn, code, again)
        if now is not None:
            yield now.summary()

    return in_batches(summaries(), SUMMARY)


class Rebuilt:
    """The repaired rows of one conversation as (audit letters so far, role last given), row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.last = FOLLOWS[self.last]
            yield ROLES[self.last], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[0]
            yield role, text
        elif edit == "R":
            self.last = FOLLOWS[self.last]
            yield ROLES[self.last], text


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries with the hash of the repaired conversation, from rows (summary or null, role, text): each summary is
    followed by the rows of its conversation."""

    def finished():
        now = None

        def told(rows):
            nonlocal lines
            for role, text in rows:
                hashed.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1

        for b in batches:
            for summary, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if summary is not None:
                    if now is not None:
                        told(edits.inserted())
                        yield (*now.values(), hashed.hexdigest())
                    now, edits, hashed, lines = summary, Rebuilt(summary["audit"]), hashlib.sha256(), 0
                else:
                    told(edits.row(role, text))
        if now is not None:
            told(edits.inserted())
            yield (*now.values(), hashed.hexdigest())

    return in_batches(finished(), RESULT)


def summaries(rows: DataFrame) -> DataFrame:
    """SUMMARY_DDL of every conversation of damaged() rows."""
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), row_code(F.col("text"), F.col("role")).alias("code"), "dropped").repartition("conv_id")
    seen = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    slim = slim.withColumn("again", F.row_number().over(seen) > 1)
    slim = slim.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "again")
    return slim.select("conv_id", "turn", "code", "again", "dropped").mapInArrow(searched, SUMMARY_DDL)


def repair(conversations: DataFrame, damage: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, with the
    contract's damage done to its rows first, or without."""
    bound_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).where(F.col("conv_id").isNotNull())
    rows = damaged(rows) if damage else undamaged(rows)
    heads = summaries(rows)
    none = F.lit(None).cast("string")
    heads = heads.select("conv_id", F.struct(heads.columns).alias("summary"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("digest"))
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(None).cast(heads.schema["summary"].dataType).alias("summary"), "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    together = heads.unionByName(texts).repartition("conv_id")
    together = together.sortWithinPartitions("conv_id", F.col("summary").isNull(), F.asc_nulls_first("turn"), "role", "digest")
    return together.select("summary", "role", "text").mapInArrow(digested, f"{SUMMARY_DDL}, repaired_sha256 string")
