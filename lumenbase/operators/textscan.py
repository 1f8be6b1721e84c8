"""BM25 and substring search for a batch of questions without an index: one scan of the texts.

An index pays where many batches follow; a batch that comes alone is answered by reading each text once, in its place. A scan
writes a short row for each chunk: how many terms it has, how often each term of the batch is in it, and which of the batch's
phrases its normalised text holds. Statistics, weights and scores derive from these rows; texts are never shuffled.

All needles of a batch are sought together: each position's first bytes (eight at most) are looked up in a table of the
needles' first bytes, and only positions found there are compared further, so a scan's work doesn't grow with the needles.
Words are sought in the same way, by their first bytes.

Normalising is most of a scan's work. Texts of Latin letters below U+0180, where no letter's small form is longer, are normalised
here, as arrays of bytes; normalize_search() has done the others, and what it gives stays as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.functions.text import STOPWORDS, normalize_search, strip
from lumenbase.operators.search import KEY
from lumenbase.sources.shared import SCOPE, kept

HEAD, TABLE_BITS, STRIDE, PIECE = 8, 20, 1 << 20, 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
LATIN_END = 0x180
#: A character whose small form is two characters.
DOTTED_I = "\u0130"
BLANK = ord(" ")


def small_forms() -> np.ndarray:
    """By code point, the small form of each letter, digit or underscore below LATIN_END, else a blank."""
    chars = [chr(c) for c in range(LATIN_END)]
    return np.array([ord(c) if c == DOTTED_I else ord(c.lower()) if c.isalpha() or c >= "À" or c in "0123456789_" else BLANK for c in chars], np.uint16)


SMALL = small_forms()
SMALL_BYTES = np.concatenate([SMALL[:128].astype(np.uint8), np.arange(128, 256, dtype=np.uint8)])
MASKS = np.array([(1 << 8 * k) - 1 for k in range(HEAD + 1)], np.uint64)


@dataclass(frozen=True)
class TextScan:
    """rows: file_type, KEY, text (as normalised() takes it, as a plan); seen: what was written for a batch, by scope and batch."""

    rows: DataFrame
    seen: dict[tuple, DataFrame] = field(default_factory=dict, compare=False)

    def of(self, *file_types: str) -> TextScan:
        return TextScan(self.rows.where(F.col("file_type").isin(*file_types)))


def text_scan(chunks: DataFrame, text: Column | None = None) -> TextScan:
    """chunks: KEY, file_type, document; text: what is searched, by default the document."""
    rows, c = chunks.select("file_type", *KEY, (F.col("document") if text is None else text).alias("text")), F.col("text")
    beyond = c.rlike(f"[^\\x00-\\u{LATIN_END - 1:04x}]|{DOTTED_I}")
    return TextScan(rows.select("file_type", *KEY, F.when(beyond, normalize_search(c)).otherwise(strip(c)).alias("text")))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each text begins and the last one ends; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normalize_search() of stripped texts of Latin letters below LATIN_END, as bytes_of() gives them; a normalised text, of
    whatever letters, stays as it is. Small forms have as many bytes as the letters."""
    low = SMALL_BYTES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 | LATIN_END >> 6))
    to = SMALL[((data[lead] & 0x1F).astype(np.uint16) << 6) | (data[lead + 1] & 0x3F)]
    low[lead], low[lead + 1] = np.where(to == BLANK, BLANK, 0xC0 | to >> 6), np.where(to == BLANK, BLANK, 0x80 | to & 0x3F)
    blank = low == BLANK
    again = blank.copy()
    again[1:] &= blank[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    return low[~again], offsets - np.searchsorted(np.flatnonzero(again), offsets)


def padded(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers."""
    held = np.zeros(len(data) + HEAD, np.uint8)
    held[: len(data)] = data
    return np.ndarray((len(data),), "<u8", held, strides=(1,))


def number(text: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(text[:HEAD], "little"))


def rest_of(n: int) -> list[int]:
    """Where to compare eight bytes each, so that all n are compared whose first eight are equal already."""
    return [*range(HEAD, n - HEAD, HEAD), n - HEAD] if n > HEAD else []


def counted_words(data: np.ndarray, offsets: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """How many terms (tokens_of()) each normalised text has, and (row, word, times) of each word that is among them."""
    rows, inside = len(offsets) - 1, data != BLANK
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    for marks, at in ((begins, offsets[filled]), (ends, offsets[filled + 1] - 1)):
        marks[at] = inside[at]
    start = np.flatnonzero(begins)
    size, first = np.flatnonzero(ends) + 1 - start, data[start]
    several = size > 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
    start, size = start[several], size[several]
    counts = np.diff(np.searchsorted(start, offsets))
    row = np.repeat(np.arange(rows), counts)
    ahead = padded(data)
    key = ahead[start] & MASKS[np.minimum(size, HEAD)]
    stop = [w.encode() for w in dict.fromkeys(STOPWORDS)]
    known = np.unique(np.array([number(w) for w in (*stop, *words)], np.uint64))
    met = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    start, size, row, key = (x[met] for x in (start, size, row, key))
    order = np.argsort(key, kind="stable")
    start, size, row, key = (x[order] for x in (start, size, row, key))

    def rows_with(word: bytes) -> np.ndarray:
        here = slice(np.searchsorted(key, number(word)), np.searchsorted(key, number(word), "right"))
        same = size[here] == len(word)
        at, of = start[here][same], row[here][same]
        for j in rest_of(len(word)):
            same = ahead[at + j] == number(word[j:])
            at, of = at[same], of[same]
        return of

    for w in stop:
        counts = counts - np.bincount(rows_with(w), minlength=rows)
    found = [(*np.unique(rows_with(w), return_counts=True), i) for i, w in enumerate(words) if w not in stop]
    none = np.zeros(0, np.int64)
    return counts, (np.concatenate([none, *(r for r, _, _ in found)]), np.concatenate([none, *(np.full(len(r), i) for r, _, i in found)]), np.concatenate([none, *(n for _, n, _ in found)]))


def found_in(texts: pa.Array, needles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, needle) of each text that holds a needle, once; needles are not empty. A null text holds none."""
    return found_within(*bytes_of(texts), needles)


def found_within(data: np.ndarray, offsets: np.ndarray, needles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """found_in() of texts as bytes_of() gives them."""
    size = len(data)
    if not size or not needles:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ahead = padded(data)
    heads = {}
    for i, needle in enumerate(needles):
        heads.setdefault(min(len(needle), HEAD), []).append(i)
    rows, which = [], []
    for k, some in heads.items():
        mask, shift = np.uint64((1 << 8 * k) - 1), np.uint64(64 - TABLE_BITS)
        keys = np.array([int.from_bytes(needles[i][:k], "little") for i in some], np.uint64)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(keys * MIX) >> shift] = True
        at = np.concatenate([s + np.flatnonzero(table[((ahead[s : s + STRIDE] & mask) * MIX) >> shift]) for s in range(0, size, STRIDE)])
        value = ahead[at] & mask
        order = np.argsort(value, kind="stable")
        at, value = at[order], value[order]
        for key, i in zip(keys, some, strict=True):
            n = len(needles[i])
            here = at[np.searchsorted(value, key) : np.searchsorted(value, key, "right")]
            row = np.searchsorted(offsets, here, "right") - 1
            within = here + n <= offsets[row + 1]
            here, row = here[within], row[within]
            for j in rest_of(n):
                same = ahead[here + j] == number(needles[i][j:])
                here, row = here[same], row[same]
            row = np.unique(row)
            rows.append(row)
            which.append(np.full(len(row), i))
    return np.concatenate(rows), np.concatenate(which)


def pieces(b: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about PIECE bytes of text."""
    parts = 1 + (pc.sum(pc.binary_length(b.column(text))).as_py() or 0) // PIECE
    step = max(1, -(-b.num_rows // parts))
    return (b.slice(k, step) for k in range(0, b.num_rows, step))


def listed(rows: int, row: np.ndarray, values: Callable[[np.ndarray], pa.Array]) -> pa.Array:
    """A list for each row of what values() gives at the places of `row` that name it."""
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values(order))


def read_once(rows: DataFrame, needles: dict[int, str], words: list[str] | None = None) -> DataFrame:
    """rows with, in place of `text`, `held` (the ids of the needles that the normalised text holds), and where words are given
    n_terms (of a null text null) and hits (array of term and tf, of the words in it)."""
    ids = np.array(list(needles), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((ids, [n.encode() for n in needles.values()], words if words is None else [w.encode() for w in words]))
    others = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in others]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), *([] if words is None else ["n_terms int", "hits array<struct<term: string, tf: int>>"]), "held array<bigint>"])

    def scanned(batches):
        ids, wanted, words = shared.value
        for b in (part for whole in batches for part in pieces(whole, "text")):
            data, offsets = normalised(*bytes_of(b.column("text")))
            out = [b.column(c) for c in names]
            if words is not None:
                counts, (row, word, times) = counted_words(data, offsets, words)
                terms = pa.array(words, pa.binary()).cast(pa.string())
                out.append(pa.array(counts.astype(np.int32), mask=pc.is_null(b.column("text")).to_numpy(zero_copy_only=False)))
                out.append(listed(b.num_rows, row, lambda o: pa.StructArray.from_arrays([terms.take(pa.array(word[o])), pa.array(times[o].astype(np.int32))], ["term", "tf"])))  # noqa: B023
            row, which = found_within(data, offsets, wanted)
            out.append(listed(b.num_rows, row, lambda o: pa.array(ids[which[o]])))  # noqa: B023
            yield pa.RecordBatch.from_arrays(out, names=[*names, *([] if words is None else ["n_terms", "hits"]), "held"])

    return rows.select(*names, "text").mapInArrow(scanned, ddl)


def term_counts(scan: TextScan) -> DataFrame:
    """KEY, n_terms of every chunk."""
    return read_once(scan.rows.select(*KEY, "text"), {}, []).select(*KEY, "n_terms")


def holding_texts(scan: TextScan, needles: DataFrame) -> DataFrame:
    """question_id, KEY of the texts that hold each needle; an empty or null one has none. needles: question_id, phrase; a
    bounded batch, which is collected."""
    wanted = {r["question_id"]: r["phrase"] for r in needles.select(F.col("question_id").cast("long"), "phrase").where("phrase <> ''").collect()}
    return read_once(scan.rows.select(*KEY, "text"), wanted).select(F.explode("held").alias("question_id"), *KEY)


def matched_rows(scan: TextScan, asked: DataFrame) -> DataFrame:
    """KEY, n_terms, hits (array of term and tf, of the batch's terms), held (the questions whose phrase the text holds), a row
    for each chunk, written once for a batch. asked: question_id, terms, phrase; a bounded batch, which is collected."""
    batch = asked.select(F.col("question_id").cast("long"), "terms", "phrase").collect()
    known = id(SCOPE.get()), tuple(sorted((r["question_id"], tuple(r["terms"] or []), r["phrase"] or "") for r in batch))
    if known in scan.seen:
        return scan.seen[known]
    words = sorted({t for r in batch for t in r["terms"] or []})
    phrases = {r["question_id"]: r["phrase"] for r in batch if r["phrase"]}
    scan.seen[known] = kept(read_once(scan.rows.select(*KEY, "text"), phrases, words), "matched")
    return scan.seen[known]
