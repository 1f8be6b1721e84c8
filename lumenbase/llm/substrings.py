"""Removal of repeated passages through a compacted De Bruijn graph of word windows.

Each window of `size` words is an edge of the De Bruijn graph over words. Windows are never shuffled one by one: those that
follow each other in a text and have the same least `k`-word hash (their minimizer) form one path piece without a branch
(a super-k-mer), and only the pieces travel, each as the hash of its minimizer, two hashes of its whole word sequence and
its source coordinates. Equal windows have equal minimizers, so they can only meet within a minimizer. Spark joins then settle
each piece:

* a minimizer that stands in one piece of the corpus only: nothing in it repeats (most pieces end here);
* an equal piece starts earlier: each of its windows repeats. Such pieces that follow each other in a text, and whose first
  occurrences follow each other in one source, are one path without a branch and are compacted to one span. Each span is
  looked up at both of its coordinates, its own and its source's, and removed when the words there have the same SHA-256;
  if they had not, the query would end;
* the first of its kind, but the minimizer has other pieces too (the ends of a repeated passage, where texts branch), or
  the piece repeats within itself: its windows are hashed one by one (128 bits) from the text at its source coordinates,
  and the earliest start of each decides.

Earlier means: smaller doc_id, or in the same document an earlier start. Windows are judged on the input. Joins run on
hashes that any number of documents may share; what is needed of such a group is its count or its minimum, which combine
before the shuffle. A minimizer that holds more than a thousandth of all pieces, of which there are less than a thousand, is
dealt over several tasks in the joins.

Two pieces count as equal if their minimizers are and two independent 64-bit hashes of the whole word sequence are: one from
the words' hashes, one of the words' bytes as the source has them. Two windows are equal if both of their 64-bit hashes are.

Defined results: null text has no words; documents with fewer words than a window lose nothing; of a passage that repeats
within one document the first stays; rows with a null id are left out and repeated ids count once (see common.keyed); an
empty table gives no rows; texts of any length are handled whole."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.llm.common import batch_of, discard, forget_caches, gram_hashes, keyed, materialize, mixed, pairs, release_later, utf8, word_hashes

PIECES = pa.schema([("a", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("folded", pa.bool_())])
PIECES_DDL = "a long, v long, w long, doc_id long, start int, n int, folded boolean"
BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE and of its inverse, modulo 2**64."""
    if len(POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            POWERS[k] = np.cumprod(steps)
    return POWERS[0], POWERS[1]


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word sequence h[start:end], from prefix sums."""
    up, down = powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * up[: len(h)])])
    return mixed((sums[end] - sums[start]) * down[start] + mixed((end - start).astype(np.uint64)))


def bytes_hashes(words: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word sequence words[start:end]."""
    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    return np.fromiter((digest(join(words[a:z])) for a, z in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))


def path_pieces(h: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """minimizer, sequence hash, first window, number of windows, whether the minimizer stands twice in it: of each piece."""
    grams = gram_hashes(h, k)
    view = np.lib.stride_tricks.sliding_window_view(grams, size - k + 1)
    at = view.argmin(1) + np.arange(len(view))
    least = grams[at]
    new = np.r_[True, least[1:] != least[:-1]]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(least)])
    moved = np.r_[False, (at[1:] != at[:-1]) & ~new[1:]]
    folded = np.add.reduceat(moved, first) > 0
    return least[first], span_hashes(h, first, first + n + size - 1), first, n, folded


def pieces_of(texts: DataFrame, size: int, k: int) -> DataFrame:
    def cut(batches):
        forget_caches()
        for b in batches:
            out = []
            for doc, text in pairs(b):
                h = word_hashes(text)
                if len(h) >= size:
                    a, v, first, n, folded = path_pieces(h, size, k)
                    w = bytes_hashes(text.split(), first, first + n + size - 1)
                    out.append((a.view(np.int64), v.view(np.int64), w.view(np.int64), np.full(len(a), doc), first.astype(np.int32), n.astype(np.int32), folded))
            if out:
                yield batch_of(PIECES, [np.concatenate(c) for c in zip(*out, strict=True)])

    return texts.mapInArrow(cut, PIECES_DDL)


SALTS = 16


def settled(texts: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, start, n, whole, source (doc_id and start of the first equal piece): pieces that go whole, and those whose
    windows must be looked at."""
    pieces = materialize(pieces_of(texts, size, k), "cut")
    counts = materialize(pieces.select("a", F.when(F.col("folded"), 2).otherwise(1).alias("c")).groupBy("a").agg(F.sum("c").alias("c")).where("c > 1"), "counts")
    hot = F.broadcast(counts.where(F.col("c") * 1000 > pieces.count()).select("a", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = pieces.join(hot, "a", "left").select(*PIECES.names, salt)
    kept = materialize(dealt.join(counts.select("a").join(hot, "a", "left").select("a", F.explode(salts).alias("salt")), ["a", "salt"]), "pieces")
    variants = kept.groupBy("a").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("w").alias("w0"), F.max("w").alias("w1"), F.max("folded").alias("any_folded"))
    variants = variants.select("a", ((F.col("v0") < F.col("v1")) | (F.col("w0") < F.col("w1")) | F.col("any_folded")).alias("open"))
    first = kept.groupBy("a", "v", "w").agg(F.min(F.struct("doc_id", "start")).alias("source"))
    firsts = first.join(variants, "a").join(hot, "a", "left").select("a", "v", "w", "source", "open", F.explode(salts).alias("salt"))
    whole = F.struct("doc_id", "start") != F.col("source")
    out = materialize(kept.join(firsts, ["a", "v", "w", "salt"]).where(whole | F.col("open")).select("doc_id", "start", "n", whole.alias("whole"), "source"), "settled")
    discard(pieces, counts, kept)
    return out


def compacted(whole: DataFrame) -> DataFrame:
    """doc_id, start, n, src_doc, src_start: pieces that follow each other, in their text and in one source, as one span."""
    order = Window.partitionBy("doc_id").orderBy("start")
    shift = F.col("src_start") - F.col("start")
    rows = whole.select("doc_id", "start", "n", F.col("source.doc_id").alias("src_doc"), F.col("source.start").alias("src_start")).withColumn("shift", shift)
    goes_on = (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start")) & (F.lag("src_doc").over(order) == F.col("src_doc")) & (F.lag("shift").over(order) == F.col("shift"))
    path = F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("path", path).groupBy("doc_id", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("src_doc").alias("src_doc"), F.min("src_start").alias("src_start")).drop("path")


def by_document(marks: DataFrame, most: int = 1 << 14) -> DataFrame:
    """doc_id and an array of its marks (start, n), about `most` at a time: a document that many others repeat has a row for
    each such part."""
    parts = marks.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).where("parts > 1")
    dealt = marks.join(parts, "doc_id", "left").withColumn("part", F.pmod(F.xxhash64("start", "n"), F.coalesce("parts", F.lit(1))))
    return dealt.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "n")).alias("marks")).drop("part")


def merged_marks(marks: DataFrame) -> DataFrame:
    """One row per document: its marks, no more than it has windows."""
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def marked_places(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Of each row, starts and sizes of its marks."""
    flat = column.flatten()
    start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    ends = np.cumsum([len(x) if x.is_valid else 0 for x in column]) if len(column) else []
    return [(start[a:z], n[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All windows of the marks."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start, n)


LOOKED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def looked_up(texts: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """h1, h2, doc_id, start, n from the texts at source coordinates. Of a mark with n > 0: two hashes of each of its n windows,
    with n 0; of one with n < 0: the first 128 bits of the SHA-256 of the words of its -n windows, with its own n."""

    def look(batches):
        for b in batches:
            out = []
            for (doc, text), (start, n) in zip(pairs(b), marked_places(b.column(2)), strict=True):
                if (n > 0).any():
                    at = spread(start[n > 0], n[n > 0])
                    both = [span_hashes(word_hashes(text, seed), at, at + size).view(np.int64) for seed in (0, 1)]
                    out.append((*both, np.full(len(at), doc), at.astype(np.int32), np.zeros(len(at), np.int32)))
                spans = np.flatnonzero(n < 0)
                if len(spans):
                    words = text.split()
                    digests = b"".join(hashlib.sha256(b" ".join(words[start[i] : start[i] - n[i] + size - 1])).digest()[:16] for i in spans)
                    two = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    out.append((two[:, 0], two[:, 1], np.full(len(spans), doc), start[spans].astype(np.int32), n[spans].astype(np.int32)))
            if out:
                yield batch_of(LOOKED, [np.concatenate(c) for c in zip(*out, strict=True)])

    return texts.join(by_document(marks), "doc_id").select("doc_id", "text", "marks").mapInArrow(look, "h1 long, h2 long, doc_id long, start int, n int")


def repeated_windows(texts: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, start, n: runs of windows whose word sequence also starts earlier."""
    found = settled(texts, size, k)
    spans = materialize(compacted(found.where("whole")), "spans")
    own = spans.select("doc_id", "start", (-F.col("n")).alias("n"))
    sources = spans.select(F.col("src_doc").alias("doc_id"), F.col("src_start").alias("start"), (-F.col("n")).alias("n"))
    looked = materialize(looked_up(texts, found.where("not whole").select("doc_id", "start", "n").unionByName(own.unionByName(sources).distinct()), size), "windows")
    windows, digests = looked.where("n = 0"), looked.where("n < 0").select("doc_id", "start", (-F.col("n")).alias("n"), F.struct("h1", "h2").alias("d"))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", F.lit(1).alias("n"))
    there = digests.select(F.col("doc_id").alias("src_doc"), F.col("start").alias("src_start"), "n", F.col("d").alias("src_d"))
    both = spans.join(digests, ["doc_id", "start", "n"], "left").join(there, ["src_doc", "src_start", "n"], "left")
    checked = F.when(F.coalesce(F.col("d") == F.col("src_d"), F.lit(False)), F.col("start")).otherwise(F.raise_error(F.lit("a repeated span isn't what stands at its source")).cast("int"))
    out = materialize(both.select("doc_id", checked.alias("start"), "n").unionByName(later), "repeats")
    release_later(texts.sparkSession, out.stored_at)
    discard(found, spans, looked)
    return out


def kept_words(text: bytes | None, start: np.ndarray, n: np.ndarray, size: int) -> tuple[list[bytes], int]:
    """(the words that stay, the number of words)."""
    words = (text or b"").split()
    if not len(start):
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + size - 1, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)], len(words)


def cleaned(docs: DataFrame, finish, schema: pa.Schema, ddl: str, size: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """finish(text, kept words, number of words) gives the columns after doc_id."""
    texts = utf8(keyed(docs, id_col, text_col))
    marks = merged_marks(repeated_windows(texts, size, k))

    def clean(batches):
        for b in batches:
            rows = [(doc, *finish(text, *kept_words(text, start, n, size))) for (doc, text), (start, n) in zip(pairs(b), marked_places(b.column(2)), strict=True)]
            yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)] or [[]] * len(schema))

    return texts.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(clean, ddl)


def removal_digests(docs: DataFrame, size: int = 20, k: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(text: bytes | None, words: list[bytes], n: int) -> tuple:
        return n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()

    return cleaned(docs, digest, schema, "doc_id long, n_words long, n_removed long, kept_sha256 string", size, k, id_col, text_col)


def remove_repeats(docs: DataFrame, size: int = 20, k: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, each text with its kept words joined by one space; a text that loses nothing stays as
    it is. Of rows with a repeated id the one with the smallest non-null text stays."""
    marks = merged_marks(repeated_windows(utf8(keyed(docs, id_col, text_col)), size, k))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    names = [f"c{i}" for i in range(len(others))]
    row = F.struct(F.col(text_col).isNull().alias("none"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(others, names, strict=True)])
    rows = keyed(docs, id_col, row, "doc_id", "row").select("doc_id", F.col("row.text").cast("binary").alias("text"), *[f"row.{n}" for n in names])
    both = rows.join(marks, "doc_id", "left").select("doc_id", "text", "marks", *names)
    kinds = ", ".join(["doc_id long", "text string", *[f"{n} {both.schema[n].dataType.simpleString()}" for n in names]])

    def clean(batches):
        for b in batches:
            texts = []
            for (_, text), (start, n) in zip(pairs(b), marked_places(b.column(2)), strict=True):
                words, total = kept_words(text, start, n, size)
                texts.append(text if len(words) == total else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *b.columns[3:]], names=["doc_id", "text", *names])

    said = dict(zip(others, names, strict=True)) | {id_col: "doc_id", text_col: "text"}
    return both.mapInArrow(clean, kinds).select(*[F.col(said[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
