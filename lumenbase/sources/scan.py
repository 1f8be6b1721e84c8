"""Office files as a Spark data source: files are dealt over tasks by their sizes, each is opened once, and filters on files and
on kinds of rows are answered before anything is opened.

    spark.dataSource.register(OfficeSource)
    spark.read.format("office").load(root)          or          scan(spark, root)

Rows have a `kind`: `file` for each file found, and from within files `block`, `cell`, `merged` (a range of a sheet from row, col
to last_row, last_col) and `error`. A file that fails gives its `file` row and one `error` row, and nothing else. Files are reached
by pyarrow.fs, whatever scheme the root has, and unzipped in place: what a task holds is one file's rows, as Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import islice
from zipfile import BadZipFile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from lumenbase.sources.office import ANY_BLOCKS, SUFFIXES, docx_blocks, row_block, xlsx_parts

FILE = ("file_id", "source", "relative_path", "file_type", "size_bytes", "modified")
BLOCK = tuple(part.split()[0] for part in ANY_BLOCKS.split(", "))
DDL = f"kind string, file_id string, source string, relative_path string, file_type string, size_bytes long, modified timestamp, error string, {ANY_BLOCKS}, col int, value string, last_row int, last_col int"
#: The columns that a file's rows differ in; a row of a file is a tuple of them.
OWN = ("kind", "error", *BLOCK, "col", "value", "last_row", "last_col")
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (part.split() for part in DDL.split(", "))])
KINDS = ("file", "block", "cell", "merged", "error")
END_RECORD = 22  # bytes of the record that every zip file ends with
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Found:
    """A file, by what its listing tells."""

    path: str
    file_id: str
    source: str
    relative_path: str
    file_type: str
    size_bytes: int
    modified: datetime


class Files(InputPartition):
    """What one task reads."""

    def __init__(self, files: list[Found]):
        super().__init__(None)
        self.files = files


def store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", root.rstrip("/")) or "/")


def found(root: str, every: bool) -> list[Found]:
    """The files below root in the order of their lower-case paths, temporary ones left out; without `every`, of the SUFFIXES
    alone. A root that isn't there is an error."""
    fs, base = store(root)
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no such directory: {root}")
    out = []
    for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        suffix = f.base_name.rpartition(".")[2].lower()
        if f.type == pafs.FileType.File and not f.base_name.startswith("~$") and (every or suffix in SUFFIXES):
            path = f.path.removeprefix(base).lstrip("/")
            name = hashlib.sha1(path.replace("\\", "/").lower().encode()).hexdigest()[:16]
            out.append(Found(f.path, name, f.base_name, path, suffix, f.size, f.mtime))
    return sorted(out, key=lambda f: (f.relative_path.lower(), f.relative_path))


def dealt(files: Iterable[Found], most: int, opening: int) -> list[Files]:
    """Tasks of about `most` bytes, `opening` a file on top of its size; a file isn't cut."""
    out: list[list[Found]] = []
    room = 0
    for f in files:
        cost = f.size_bytes + opening
        if not out or cost > room:
            out.append([])
            room = most
        out[-1].append(f)
        room -= cost
    return [Files(x) for x in out]


def own(**values) -> tuple:
    return tuple(values.get(name) for name in OWN)


def block_rows(blocks: Iterable[tuple]) -> Iterator[tuple]:
    for row in blocks:
        yield "block", None, *row, *[None] * (len(BLOCK) - len(row)), None, None, None, None


def rows_of(f: Found, data, kinds: set[str], row_blocks: bool = True) -> Iterator[tuple]:
    """What a file holds of the kinds, in one pass, as tuples of OWN; without row_blocks, workbooks give no blocks."""
    if f.file_type in ("docx", "xlsx", "xlsm") and f.size_bytes < END_RECORD:
        raise BadZipFile("File is not a zip file")
    if f.file_type == "docx":
        yield from block_rows(docx_blocks(data) if "block" in kinds else ())
    elif f.file_type in ("xlsx", "xlsm"):
        index, blank = 0, own()
        before, between = blank[2 : OWN.index("sheet")], blank[OWN.index("row") + 1 : OWN.index("col")]
        for sheet, cells, merged in xlsx_parts(data):
            if merged and "merged" in kinds:
                yield own(kind="merged", sheet=sheet, **dict(zip(("row", "col", "last_row", "last_col"), merged, strict=True)))
            for r, c, v in cells if "cell" in kinds else ():
                yield "cell", None, *before, sheet, r, *between, c, v, None, None
            if row_blocks and "block" in kinds and (block := row_block(sheet, cells)):
                yield from block_rows([(index, *block)])
                index += 1
    else:
        raise ValueError("no extractor for pdf" if f.file_type == "pdf" else f"Unsupported file type: .{f.file_type}")


def batches_of(rows: Iterable[tuple], f: Found, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of a file's rows; what is the same in all of them isn't held row by row."""
    rows, told = iter(rows), {name: pa.scalar(getattr(f, name), SCHEMA.field(name).type) for name in FILE}
    while held := list(islice(rows, size)):
        columns = {name: pa.repeat(value, len(held)) for name, value in told.items()}
        for name, values in zip(OWN, zip(*held, strict=True), strict=True):
            columns[name] = pa.array(values, SCHEMA.field(name).type)
        yield pa.RecordBatch.from_arrays([columns[name] for name in SCHEMA.names], schema=SCHEMA)


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.every = options.get("every", "false").lower() == "true"
        self.required = options.get("required", "false").lower() == "true"
        self.most = int(options.get("partitionbytes", 16 << 20))
        self.opening = int(options.get("openbytes", 1 << 18))
        self.row_blocks = options.get("rowblocks", "true").lower() == "true"
        self.kinds = set(KINDS)
        self.tests: list[tuple[str, tuple | str]] = []  # (attribute, values or the beginning of one)

    def partitions(self) -> list[Files]:
        files = found(self.root, self.every)
        if self.required and not files:
            raise FileNotFoundError(f"no office files in {self.root}")
        return dealt((f for f in files if all(self.holds(f, *t) for t in self.tests)), self.most, self.opening)

    @staticmethod
    def holds(f: Found, name: str, wanted: tuple | str) -> bool:
        value = getattr(f, name)
        return value.startswith(wanted) if isinstance(wanted, str) else value in wanted

    def opened(self, f: Found):
        return store(self.root)[0].open_input_file(f.path)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for f in partition.files if partition else ():  # without any file, Spark still reads once
            if "file" in self.kinds:
                yield from batches_of([own(kind="file")], f)
            if self.kinds <= {"file"}:
                continue
            try:
                with self.opened(f) as data:
                    whole = list(batches_of(rows_of(f, data, self.kinds, self.row_blocks), f))
            except Exception as e:  # noqa: BLE001  any fault of one file is recorded, and the others go on
                whole = list(batches_of([own(kind="error", error=f"{type(e).__name__}: {e}")], f)) if "error" in self.kinds else []
            yield from whole


class PruningReader(OfficeReader):
    """Answers filters on the kind of row, and on what the listing tells of a file; the others stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, (EqualTo, StringStartsWith)) else ()
            if name == "kind" and values and not isinstance(f, StringStartsWith):
                self.kinds &= set(values)
            elif name in ("file_id", "source", "relative_path", "file_type") and values:
                self.tests.append((name, f.value if isinstance(f, StringStartsWith) else tuple(values)))
            else:
                yield f


class OfficeSource(DataSource):
    """Options: path; every (files of other kinds too, each an error); required (no file at all is an error); partitionBytes and
    openBytes, the sizes by which files are dealt; rowBlocks (false: rows of workbooks give cells alone, no blocks); pruning, that the session answers filters (scan() sets it)."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PruningReader if options.get("pruning", "false").lower() == "true" else OfficeReader)(options)


def scan(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """All rows of the files below root. Filters reach the reader where the session has PUSHDOWN on."""
    spark.dataSource.register(OfficeSource)
    pruning = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("office").options(pruning=pruning, **options).load(root)


def blocks(rows: DataFrame) -> DataFrame:
    """The blocks of a scan, with the columns that block_table() takes; files that failed have a row with the error."""
    return rows.where(F.col("kind").isin("block", "error")).select("file_id", "source", "relative_path", "error", *BLOCK)


def cells(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'cell'").select("file_id", "source", "relative_path", "sheet", "row", "col", "value")


def merged(rows: DataFrame) -> DataFrame:
    found = rows.where("kind = 'merged'")
    return found.select("file_id", "source", "relative_path", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("last_row").alias("max_row"), F.col("last_col").alias("max_col"))
