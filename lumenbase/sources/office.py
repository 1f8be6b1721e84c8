"""Files of office documents: discovery, and blocks and cells of DOCX and XLSX, read with the standard library.

One row in is one file; a file that can't be read gives an error and leaves the others alone. XML is read as a stream: what is
held of it is one paragraph, table or row, beside a workbook's shared strings. PDF pages come from an extractor that the
caller passes, for none is part of the environment."""

from __future__ import annotations

import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import lru_cache, reduce
from io import BytesIO
from typing import IO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.functions.text import file_id, numbered_id
from lumenbase.operators.chunking import FIRST_SECTION

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SUFFIXES = ("pdf", "docx", "xlsx", "xlsm")
CELL, VALUE, INLINE = f"{S}c", f"{S}v", f"{S}is"
WHOLE = re.compile(r"[+-]?[0-9]+")
HEADING = re.compile(r"^[IVXLC]+[.)]\s+", re.I)
BLOCKS = "block_index int, block_type string, text string, section string, item_index int, style string, table_number int, page int"


def discover(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """file_id, relative_path, source, file_type, size_bytes, modified, content: supported files below root (with `every`,
    others too, which read_files() reports), temporary ones left out. Contents are read by the steps that use them and never
    sorted; listed() orders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(base)}/", "")
    name = F.element_at(F.split(relative, "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    good = files.select(relative.alias("relative_path"), name.alias("source"), kind.alias("file_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    good = good.where(~F.col("source").startswith("~$") & (F.lit(every) | F.col("file_type").isin(*SUFFIXES)))
    return good.select(file_id(F.col("relative_path")).alias("file_id"), "*")


def listed(files: DataFrame) -> DataFrame:
    """The files without their contents, in the order of their lower-case paths."""
    return files.drop("content").orderBy(F.lower("relative_path"))


def clean(text: str | None) -> str:
    composed = unicodedata.normalize("NFC", text or "")
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in re.sub(r"\r\n?", "\n", composed).split("\n"))
    return "\n".join(x for x in lines if x)


def paragraph_text(p: ET.Element) -> str:
    return "".join({f"{W}t": e.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(e.tag, "") for e in p.iter())


def table_rows(table: ET.Element) -> Iterator[list[str]]:
    """The cell texts of a table's own rows. A cell over several columns stands once for each; one that goes on below stands
    in each row; a table within a cell gives no text of its own."""
    above: list[str] = []
    for row in table.findall(f"{W}tr"):
        texts: list[str] = []
        for c in row.findall(f"{W}tc"):
            span, down = c.find(f"{W}tcPr/{W}gridSpan"), c.find(f"{W}tcPr/{W}vMerge")
            goes_on = down is not None and down.get(f"{W}val", "continue") != "restart"
            text = above[len(texts)] if goes_on and len(texts) < len(above) else clean("\n".join(paragraph_text(p) for p in c.findall(f"{W}p")))
            texts += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
        above = texts
        yield texts


def archive(data: bytes | IO[bytes]) -> zipfile.ZipFile:
    return zipfile.ZipFile(BytesIO(data) if isinstance(data, bytes) else data)


def ended(xml: IO[bytes], parent: str, *others: str) -> Iterator[ET.Element]:
    """The elements right below a parent, and the others wherever they stand, each as it ends. What has been given is
    forgotten when the next one is asked for."""
    above: list[ET.Element] = []
    level = 0  # of the outermost parent that is open
    for event, e in ET.iterparse(xml, ("start", "end")):
        if event == "start":
            above.append(e)
            if not level and e.tag == parent:
                level = len(above)
            continue
        above.pop()
        if len(above) < level:
            level = 0
        if 0 < level == len(above) or e.tag in others:
            yield e
            above[-1].remove(e)


def docx_blocks(data: bytes | IO[bytes]) -> Iterator[tuple]:
    """Paragraphs and tables in document order, with the running section, style and table number."""
    with archive(data) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                names[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
        with z.open("word/document.xml") as xml:
            yield from item_blocks(ended(xml, f"{W}body"), names)


def item_blocks(items: Iterator[ET.Element], names: dict[str, str | None]) -> Iterator[tuple]:
    section, tables, index = FIRST_SECTION, 0, 0
    for item, e in enumerate((x for x in items if x.tag in (f"{W}p", f"{W}tbl")), 1):
        if e.tag == f"{W}p":
            text = clean(paragraph_text(e))
            if not text:
                continue
            section = text if HEADING.match(text) else section
            style = e.find(f"{W}pPr/{W}pStyle")
            style = names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else None
            yield index, "paragraph", text, section, item, style, None, None
            index += 1
        elif e.tag == f"{W}tbl":
            tables += 1
            lines = []
            for r, cells in enumerate(table_rows(e), 1):
                filled = " | ".join(f"Ô {c}: {v}" for c, v in enumerate(cells, 1) if v)
                lines += [f"Dòng {r}: {filled}"] if filled else []
            if lines:
                yield index, "table", "\n".join(lines), section, item, None, tables, None
                index += 1


def position(ref: str) -> tuple[int, int]:
    """'B3' to (3, 2)."""
    letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for x in letters:
        col = 26 * col + ord(x) - 64
    return int(row), col


#: Numbers of the built-in formats for dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def date_styles(z: zipfile.ZipFile) -> list[bool]:
    """Of each cell style of a workbook, whether it shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{S}numFmt")}
    plain = {k: re.sub(r'"[^"]*"|\\[^\s]|\[(?!h|m|s)[^\]]*\]', "", code.lower()) for k, code in own.items()}
    dated = {k for k, code in plain.items() if re.search("[ymdhs]", code)} | (DATE_FORMATS - set(own))
    return [int(x.get("numFmtId") or 0) in dated for x in root.findall(f"{S}cellXfs/{S}xf")]


@lru_cache(1 << 14)
def shown_date(number: float, from_1904: bool) -> str:
    """A serial number as a date with its time, or as a time alone below one day."""
    moment = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if number >= 60 else 31)
    moment += timedelta(seconds=round(number * 86_400))
    return moment.strftime("%H:%M:%S") if 0 <= number < 1 else moment.strftime("%Y-%m-%d %H:%M:%S")


def cell_value(kind: str | None, raw: str, shared: list[str], dated: bool, from_1904: bool) -> str:
    """A stored value as text: shared strings, True and False, dates, whole numbers without a fraction."""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw.strip() in ("1", "true") else "False"
    if kind in (None, "n"):
        number = float(raw)
        if dated:
            return shown_date(number, from_1904)
        return str(int(number)) if WHOLE.fullmatch(raw.strip()) else repr(number)
    return raw


def rich_text(e: ET.Element) -> str:
    """The text of a string item or its runs, without phonetic ones."""
    return "".join([t.text or "" for part in (e, *e.findall(f"{S}r")) for t in part.findall(f"{S}t")])


def xlsx_parts(data: bytes | IO[bytes]) -> Iterator[tuple[str, list[tuple[int, int, str]], tuple[int, int, int, int] | None]]:
    """(sheet, the filled cells of a row as (row, col, text), None) for each row, and (sheet, [], (first row, first col, last
    row, last col)) for each merged range, in the order of the file."""
    with archive(data) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as xml:
                shared = [rich_text(si) for si in ended(xml, f"{S}sst") if si.tag == f"{S}si"]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book, dated = ET.fromstring(z.read("xl/workbook.xml")), date_styles(z)
        told = book.find(f"{S}workbookPr")
        from_1904 = told is not None and told.get("date1904") in ("1", "true")
        for sheet in book.iter(f"{S}sheet"):
            target = targets[sheet.get(f"{R}id")].lstrip("/")
            at_row = 0
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as xml:
                for e in ended(xml, f"{S}sheetData", f"{S}mergeCell"):
                    if e.tag == f"{S}mergeCell":
                        first, _, last = e.get("ref").partition(":")
                        if last:
                            yield sheet.get("name"), [], (*position(first), *position(last))
                        continue
                    cells, at_row, at_col = [], int(e.get("r") or at_row + 1), 0
                    for c in e.findall(CELL):
                        ref, kind, style = c.get("r"), c.get("t"), int(c.get("s") or 0)
                        at_row, at_col = position(ref) if ref else (at_row, at_col + 1)
                        if kind == "inlineStr" and (inline := c.find(INLINE)) is not None:
                            cells.append((at_row, at_col, rich_text(inline)))
                        elif (v := c.find(VALUE)) is not None and v.text is not None:
                            cells.append((at_row, at_col, cell_value(kind, v.text, shared, style < len(dated) and dated[style], from_1904)))
                    yield sheet.get("name"), cells, None


def each_file(files: DataFrame, kinds: tuple[str, ...], read: Callable[[bytes], Iterator[tuple]], ddl: str) -> DataFrame:
    """file_id, source, relative_path, error and the read columns: a row for each thing read; of a file that fails, one row
    with the error."""
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f in b.itertuples():
                try:
                    out += [(f.file_id, f.source, f.relative_path, None, *row) for row in list(read(f.content))]
                except Exception as e:  # noqa: BLE001  any fault of one file is recorded, and the others go on
                    out.append((f.file_id, f.source, f.relative_path, f"{type(e).__name__}: {e}", *[None] * len(names)))
            yield pd.DataFrame(out, columns=["file_id", "source", "relative_path", "error", *names]).astype(object)

    wanted = files.where(F.col("file_type").isin(*kinds)).select("file_id", "source", "relative_path", "content")
    return wanted.mapInPandas(run, f"file_id string, source string, relative_path string, error string, {ddl}")


def read_docx(files: DataFrame) -> DataFrame:
    return each_file(files, ("docx",), docx_blocks, BLOCKS)


def pdf_blocks(pages: Callable[[bytes], list[str]]) -> Callable[[bytes], Iterator[tuple]]:
    def blocks(data: bytes) -> Iterator[tuple]:
        filled = [(n, clean(t)) for n, t in enumerate(pages(data), 1)]
        return ((k, "page", t, None, None, None, None, n) for k, (n, t) in enumerate((n, t) for n, t in filled if t))

    return blocks


def read_pdf(files: DataFrame, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """One block for each page that has text, numbered from 1. pages: a file's bytes to its pages' texts."""
    return each_file(files, ("pdf",), pdf_blocks(pages), BLOCKS)


def read_cells(files: DataFrame) -> DataFrame:
    """sheet, row, col, value of every filled cell."""
    return each_file(files, ("xlsx", "xlsm"), lambda d: ((s, r, c, v) for s, cells, _ in xlsx_parts(d) for r, c, v in cells), "sheet string, row int, col int, value string")


def read_merged(files: DataFrame) -> DataFrame:
    return each_file(files, ("xlsx", "xlsm"), lambda d: ((s, *m) for s, _, m in xlsx_parts(d) if m), "sheet string, min_row int, min_col int, max_row int, max_col int")


def good(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error")


def file_manifest(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, source, relative_path, file_type, content_sha1, blocks, errors."""
    told = rows.groupBy("file_id").agg(F.count(F.when(F.col("error").isNull(), 1)).cast("int").alias("blocks"), F.collect_set("error").alias("errors"))
    return files.select("file_id", "source", "relative_path", "file_type", F.sha1("content").alias("content_sha1")).join(told, "file_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0))).withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def sheet_rows(data: bytes | IO[bytes]) -> Iterator[tuple]:
    """A block for each row of each sheet that holds something: its cells as 'A1=v | B1=v' under sheet and row. Rows come in the
    order of the file, which is by their numbers."""
    index = 0
    for name, cells, _ in xlsx_parts(data):
        if block := row_block(name, cells):
            yield index, *block
            index += 1


def row_block(sheet: str, cells: list[tuple[int, int, str]]) -> tuple | None:
    """The block of a row but for its index; None where no cell has a text."""
    filled = [(r, c, v) for r, c, v in ((r, c, clean(v)) for r, c, v in cells) if v]
    if not filled:
        return None
    row, line = filled[0][0], " | ".join(f"{letters(c)}{r}={v}" for r, c, v in filled)
    return "row", f"Trang tính: {sheet}\nDòng: {row}\n{line}", None, None, None, None, None, sheet, row


def letters(col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


ANY_BLOCKS = f"{BLOCKS}, sheet string, row int"


def read_files(files: DataFrame, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """The blocks of files of all kinds, each read by what its suffix asks for: file_id, source, relative_path, error and the
    columns of ANY_BLOCKS. A file of another kind, and a PDF without an extractor, is one row with the error."""

    def unread(data: bytes) -> Iterator[tuple]:
        raise ValueError("no extractor for pdf")

    wide = lambda read: lambda d: ((*row, None, None) for row in read(d))
    kinds = {("docx",): wide(docx_blocks), ("xlsx", "xlsm"): sheet_rows, ("pdf",): wide(pdf_blocks(pages)) if pages else unread}
    parts = [each_file(files, k, read, ANY_BLOCKS) for k, read in kinds.items()]
    others = files.where(~F.col("file_type").isin(*SUFFIXES))
    message = F.concat(F.lit("ValueError: Unsupported file type: ."), "file_type")
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in ANY_BLOCKS.split(", "))]
    parts.append(others.select("file_id", "source", "relative_path", message.alias("error"), *empty))
    return reduce(DataFrame.unionByName, parts)


def block_table(files: DataFrame, rows: DataFrame) -> DataFrame:
    """schemas.BLOCKS of the rows that were read."""
    place = F.struct("page", "section", "item_index", "style", "table_number", "sheet", "row")
    kinds = files.select("file_id", "file_type")
    return good(rows).join(kinds, "file_id").select(numbered_id(F.col("file_id"), "b", F.col("block_index")).alias("id"), "file_id", "source", "relative_path", "file_type", "block_index", "block_type", "text", place.alias("location"))
