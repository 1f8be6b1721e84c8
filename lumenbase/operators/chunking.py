"""Blocks of documents to chunks: greedy packing, section and table numbering, identities and manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.functions.text import clean_text, is_heading, numbered_id, retrieval_text
from lumenbase.sources.shared import kept

MAX_CHARS, MAX_TABLE_CHARS = 1400, 5000
FIRST_SECTION = "Phần mở đầu"


def pack_lines(text: Column, most: int | Column = MAX_CHARS) -> Column:
    """pack_clean() of any text."""
    return pack_clean(clean_text(text), most)


def pack_clean(clean: Column, most: int | Column = MAX_CHARS, mark: str | None = None) -> Column:
    """array<string>: the cleaned text's lines packed in order into parts of at most `most` characters, line breaks counted;
    a longer line is a part of its own. A fold, for where a part ends depends on where the last one did. mark: a character
    that ends a part wherever it stands, and goes; whether a line fits is measured from the last one on."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    lines = F.filter(F.split(clean, "\n"), lambda x: x != "")

    def folded(tail: Callable[[Column], Column]) -> Column:
        def step(s: Column, line: Column) -> Column:
            fits = s["now"].isNotNull() & (F.length(tail(s["now"])) + 1 + F.length(line) <= most)
            done = F.when(s["now"].isNull() | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
            return F.struct(done.alias("done"), F.when(fits, F.concat(s["now"], F.lit("\n"), line)).otherwise(line).alias("now"))

        return F.aggregate(lines, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))

    parts = folded(lambda now: now)
    if mark is None:
        return parts
    cut = F.flatten(F.transform(folded(lambda now: F.substring_index(now, mark, -1)), lambda p: F.split(p, rf"\Q{mark}\E")))
    return F.when(clean.contains(mark), cut).otherwise(parts)


def block_parts(block_type: Column, clean: Column, most: int = MAX_CHARS, most_table: int = MAX_TABLE_CHARS, mark: str | None = None) -> Column:
    """array<string>: a table or a text within its bound whole, else packed up to that bound; nothing for an empty text. clean:
    the text as clean_text() gives it, best a column of its own. mark: as in pack_clean()."""
    bound = F.when(block_type == "table", most_table).otherwise(most)
    return F.when(clean == "", F.array().cast("array<string>")).when(F.length(clean) <= bound, F.array(clean)).otherwise(pack_clean(clean, bound, mark))


def running_section(blocks: DataFrame, by: str = "file_id", order: str = "block_index") -> DataFrame:
    """With `section`: the last heading so far, the heading itself included."""
    sofar = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(is_heading(F.col("text")), F.col("text")), True).over(sofar), F.lit(FIRST_SECTION)))


def table_numbers(blocks: DataFrame, by: str = "file_id", order: str = "block_index") -> DataFrame:
    """With `table_number`: of a table, how many there are up to it; of others null."""
    sofar = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_table = F.col("block_type") == "table"
    return blocks.withColumn("table_number", F.when(is_table, F.sum(F.when(is_table, 1).otherwise(0)).over(sofar)))


def renumbered(rows: DataFrame, by: str = "file_id", order: str = "pos") -> DataFrame:
    """With chunk_index from 0 within each file."""
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def paged_chunks(blocks: DataFrame) -> DataFrame:
    """file_id, block_index, part, text: each page's parts."""
    clean = blocks.select("file_id", "block_index", "block_type", clean_text(F.col("text")).alias("clean"))
    return clean.select("file_id", "block_index", F.posexplode(block_parts(F.col("block_type"), F.col("clean"))).alias("part", "text"))


def last_fitting(rows: DataFrame, by: list[str], reach: Column, end: Column) -> DataFrame:
    """by, place, fitting: the greatest place of the same group whose `end` is at most the row's `reach`; null if there is none.
    A range search as one sort: ends and reaches are put in one order, and each reach takes the last end before it."""
    ends = rows.select(*by, F.col("place").alias("at"), F.lit(None).cast("long").alias("place"), end.alias("value"), F.lit(0).alias("asks"))
    asks = rows.select(*by, F.lit(None).cast("long").alias("at"), F.col("place").cast("long").alias("place"), reach.alias("value"), F.lit(1).alias("asks"))
    before = Window.partitionBy(*by).orderBy("value", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("at", F.col("at").cast("long")).unionByName(asks).withColumn("fitting", F.max("at").over(before)).where("asks = 1").select(*by, "place", "fitting")


def greedy_starts(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, place: where each part of a greedy packing begins, group by group; the place behind a group's last row, where no part
    begins any more, may be among them. rows: by, place, size (one more than the row's
    characters), upto (sum of the sizes up to it).

    From each row follows where the next part would begin if one began there. The starts are the rows reached from a group's
    first one; they are found by pointer doubling, for which a group of n parts needs log2(n) joins and no task holds a
    group."""
    before = F.col("upto") - F.col("size")
    fitting = last_fitting(rows, by, before + most + 1, F.col("upto"))
    jumps = kept(fitting.select(*by, "place", (F.greatest(F.coalesce("fitting", F.lit(0)), F.col("place")) + 1).alias("to")), "jumps")
    sizes = rows.groupBy(*by).agg(F.min("place").cast("long").alias("place"), F.sum("size").alias("size"))
    starts, longest = sizes.select(*by, "place"), sizes.agg(F.max("size")).first()[0] or 0
    reached, parts = 1, 2 * longest // most + 2  # two parts that follow each other are longer than one may be
    while reached < parts:
        further = starts.join(jumps, [*by, "place"]).select(*by, F.col("to").alias("place"))
        starts, reached = kept(starts.unionByName(further), "starts"), 2 * reached
        if reached < parts:
            jumps = kept(jumps.join(jumps.select(*by, F.col("place").alias("to"), F.col("to").alias("beyond")), [*by, "to"]).select(*by, "place", F.col("beyond").alias("to")), "jumps")
    return starts


def flowing_chunks(blocks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """file_id, n, block_indexes, block_types, text of flowing documents. blocks: file_id, block_index, block_type, section,
    text.

    A table stands alone; a heading and a change of section begin a chunk, and so does a part that would not fit. What fits
    depends on all before it up to the last such break. Stretches between breaks that are short enough are a chunk; the
    starts within longer ones are found by greedy_starts()."""
    clean = blocks.withColumn("clean", clean_text(F.col("text"))).withColumn("kind", F.when(F.col("block_type") == "table", "table").when(is_heading(F.col("clean")), "heading").otherwise("text"))
    parts = F.when(F.col("kind") == "heading", F.array("clean")).otherwise(block_parts(F.col("block_type"), F.col("clean")))
    parts = clean.select("file_id", "block_index", "block_type", "section", "kind", F.posexplode(parts).alias("part", "text"))
    order = Window.partitionBy("file_id").orderBy("block_index", "part")
    sofar, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file_id", "stretch")
    last = F.lag("kind").over(order)
    breaks = last.isNull() | (last == "table") | F.col("kind").isin("table", "heading") | ~F.lag("section").over(order).eqNullSafe(F.col("section"))
    rows = parts.withColumn("place", F.row_number().over(order)).withColumn("break", breaks).withColumn("size", F.length("text") + 1)
    rows = rows.withColumn("stretch", F.sum(F.col("break").cast("int")).over(sofar)).withColumn("upto", F.sum("size").over(sofar))
    rows = kept(rows.withColumn("long", F.sum("size").over(whole) - 1 > most).drop("kind", "section", "part"), "parts")
    starts = greedy_starts(rows.where("long"), ["file_id", "stretch"], most).select("file_id", "stretch", F.col("place").cast("int").alias("place"), F.lit(True).alias("starts"))
    begun = rows.join(starts, ["file_id", "stretch", "place"], "left").withColumn("begins", F.col("break") | F.coalesce("starts", F.lit(False)))
    numbered = begun.withColumn("n", (F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    held = numbered.groupBy("file_id", "n").agg(F.array_sort(F.collect_list(F.struct("place", "block_index", "text"))).alias("held"), F.sort_array(F.collect_set("block_type")).alias("block_types"))
    return held.select("file_id", "n", F.col("held.block_index").alias("block_indexes"), "block_types", F.array_join("held.text", "\n").alias("text"))


def whole_blocks(blocks: DataFrame) -> DataFrame:
    """A chunk for each block with text: what a sheet without a readable workbook falls back to, and files of other kinds."""
    text = clean_text(F.col("text"))
    return blocks.select("file_id", "block_index", F.lit(0).alias("part"), text.alias("text")).where("text <> ''")


def parts_as_chunks(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks that come from one block each, in the blocks' order: file_id, n, block_indexes, block_types, text."""
    typed = parts.join(blocks.select("file_id", "block_index", "block_type"), ["file_id", "block_index"])
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("block_index", "part")) - 1
    return typed.select("file_id", n.alias("n"), F.array("block_index").alias("block_indexes"), F.array("block_type").alias("block_types"), "text")


def sheet_chunks(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks of timetables: a record of class, day and session (see reshape.class_sessions, with file_id) and the block of
    its first row, else the file's first one, whose place its own columns extend. blocks: file_id, block_index, block_type
    and location. Gives file_id, n, block_indexes, block_types, text, extra."""
    placed = blocks.where("location.sheet is not null and location.row is not null")
    own = placed.groupBy("file_id", F.col("location.sheet").alias("sheet"), F.col("location.row").alias("row_start")).agg(F.max(F.struct("block_index", "block_type")).alias("own"))
    first = blocks.groupBy("file_id").agg(F.min(F.struct("block_index", "block_type")).alias("first"))
    block = F.coalesce("own", "first")
    extra = F.struct("sheet", "row_start", "row_end", "day", "session", "class_name", "grade", F.array_join("periods", ",").alias("periods"))
    joined = records.join(own, ["file_id", "sheet", "row_start"], "left").join(first, "file_id")
    return joined.select("file_id", (F.col("n") - 1).alias("n"), F.array(block["block_index"]).alias("block_indexes"), F.array(block["block_type"]).alias("block_types"), clean_text(F.col("text")).alias("text"), extra.alias("extra"))


def make_chunks(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """The chunk table (schemas.CHUNKS) from pieces (file_id, n, block_indexes, block_types, text, which is clean, and extra if they
    add to the place): numbered from 0 in each file, with the blocks' ids, and the place of the first block, extended by what is extra."""
    first = blocks.select("file_id", F.col("block_index").alias("at"), "source", "relative_path", "file_type", "location")
    joined = renumbered(pieces, "file_id", "n").withColumn("at", F.col("block_indexes")[0]).join(first, ["file_id", "at"])
    own = {f: F.col(f"location.{f}") for f in ("page", "section", "item_index", "style", "table_number", "sheet", "row")}
    more = {f: F.col(f"extra.{f}") if "extra" in pieces.columns else F.lit(None) for f in ("row_start", "row_end", "day", "session", "class_name", "grade", "periods")}
    kinds = {"row_start": "int", "row_end": "int"}
    if "extra" in pieces.columns:
        own["sheet"] = F.coalesce("extra.sheet", "location.sheet")
    location = F.struct(*[c.alias(f) for f, c in own.items()], *[c.cast(kinds.get(f, "string")).alias(f) for f, c in more.items()])
    named = joined.withColumn("place", location)
    return named.select(
        numbered_id(F.col("file_id"), "c", F.col("chunk_index")).alias("id"), "file_id", "source", "relative_path", "file_type", "chunk_index",
        F.transform("block_indexes", lambda i: numbered_id(F.col("file_id"), "b", i)).alias("block_ids"), F.array_sort(F.array_distinct("block_types")).alias("block_types"),
        F.col("place").alias("location"), "text", retrieval_text(F.col("source"), F.col("place.section"), F.col("text")).alias("retrieval_text"), F.length("text").alias("char_count"),
    )


def build_chunks(blocks: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """The chunks of all files: flowing for docx, by page for pdf, by class and half day for workbooks whose records are given
    (file_id and the columns of reshape.class_sessions), one for each block for other workbooks and other kinds. blocks: as
    schemas.BLOCKS."""
    docx, pdf = blocks.where("file_type = 'docx'"), blocks.where("file_type = 'pdf'")
    rest = blocks.where("file_type not in ('docx', 'pdf')")
    chunks = make_chunks(flowing_chunks(docx.withColumn("section", F.coalesce("location.section", F.lit("")))), docx)
    chunks = chunks.unionByName(make_chunks(parts_as_chunks(paged_chunks(pdf), pdf), pdf))
    if records is not None:
        known = records.select("file_id").distinct()
        sheets = rest.where("file_type in ('xlsx', 'xlsm')").join(known, "file_id", "left_semi")
        chunks = chunks.unionByName(make_chunks(sheet_chunks(records, sheets), sheets))
        rest = rest.join(known, "file_id", "left_anti")
    return chunks.unionByName(make_chunks(parts_as_chunks(whole_blocks(rest), rest), rest))


def build_manifest(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, source, file_type, blocks, chunks: a row for each file, and one of all (file_id null)."""
    per = blocks.groupBy("file_id").agg(F.min("source").alias("source"), F.min("file_type").alias("file_type"), F.count(F.lit(1)).alias("blocks"))
    per = per.join(chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks")), "file_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    every = per.agg(F.sum("blocks").alias("blocks"), F.sum("chunks").alias("chunks"))
    return per.unionByName(every.select(F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("file_type"), "blocks", "chunks"))


def manifest(chunks: DataFrame) -> DataFrame:
    """file_type, files, chunks, chars, longest: by type, with a row of all (file_type null)."""
    return chunks.rollup("file_type").agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars"), F.max("char_count").alias("longest"))


def row_text(cells: DataFrame) -> DataFrame:
    """source, sheet, row, text: filled cells of each row of a sheet as 'A1=v | B1=v', under sheet and row."""
    filled = cells.withColumn("v", clean_text(F.col("value"))).where("v <> ''")
    entry = F.concat(column_letters(F.col("col")), F.col("row").cast("string"), F.lit("="), F.col("v"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", entry.alias("e")))), lambda x: x["e"]), " | ")
    return filled.groupBy("source", "sheet", "row").agg(listed.alias("cells")).select("source", "sheet", "row", F.concat_ws("\n", F.concat(F.lit("Trang tính: "), "sheet"), F.concat(F.lit("Dòng: "), F.col("row").cast("string")), "cells").alias("text"))


def column_letters(col: Column) -> Column:
    """1 to A, 27 to AA, up to three letters."""
    z = col - 1
    letter = lambda n: F.char(n.cast("int") + 65)
    one, two = letter(z % 26), letter(F.floor(z / 26 - 1) % 26)
    three = letter(F.floor((F.floor(z / 26) - 1) / 26) - 1)
    return F.concat(F.when(z >= 702, three).otherwise(F.lit("")), F.when(z >= 26, two).otherwise(F.lit("")), one)


def table_text(cells: DataFrame) -> DataFrame:
    """source, table_number, text: rows of a table as 'Dòng r: Ô c: v | ...'; empty cells go, and empty rows, whose number
    still counts. A cell of several lines keeps them."""
    filled = cells.withColumn("v", clean_text(F.col("value"))).where("v <> ''")
    by = ["source", "table_number"]
    entry = F.concat(F.lit("Ô "), F.col("col").cast("string"), F.lit(": "), F.col("v"))
    lines = filled.groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", entry.alias("e")))), lambda x: x["e"]), " | ").alias("line"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: F.concat(F.lit("Dòng "), x["row"].cast("string"), F.lit(": "), x["line"]))
    return lines.groupBy(*by).agg(F.array_join(text, "\n").alias("text"))

