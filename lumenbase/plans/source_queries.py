"""Queries of sources: workbooks and letters made of orders and parts, read by the office data source; chunks clustered by
file."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from io import BytesIO
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.plans.registry import query
from lumenbase.plans.views import CHUNKS, chunk_view, table
from lumenbase.sources import clustered, scan
from lumenbase.sources.shared import built_once, bytes_of, new_path

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
ORDERS, PARTS = 500, 200  # rows a workbook, rows a letter


def packed_file(parts: dict[str, str]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def sheet_xml(rows: list[list[str]], merged: str = "") -> str:
    """Rows of cell elements; their references are left to their order."""
    body = "".join(f"<row>{''.join(cells)}</row>" for cells in rows)
    return f"<worksheet {S}><sheetData>{body}</sheetData>{merged}</worksheet>"


def workbook(name: str, orders: pd.DataFrame) -> bytes:
    """A sheet with a merged title and number, priority (a shared string), price and date of each order, and one with states."""
    told = sorted(set(orders.o_orderpriority))
    days = (orders.o_orderdate - pd.Timestamp(1899, 12, 30)).dt.days
    number, text = "<c><v>{}</v></c>", '<c t="inlineStr"><is><t>{}</t></is></c>'
    rows = [
        [number.format(key), f'<c t="s"><v>{told.index(priority)}</v></c>', number.format(repr(float(price))), f'<c s="1"><v>{day}</v></c>']
        for key, priority, price, day in zip(orders.o_orderkey, orders.o_orderpriority, orders.o_totalprice, days, strict=True)
    ]
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in ((1, "orders"), (2, "states")))
    links = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2))
    return packed_file({
        "xl/workbook.xml": f"<workbook {S} {R}><sheets>{sheets}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}>{''.join(f'<si><t>{escape(x)}</t></si>' for x in told)}</sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet_xml([[text.format(escape(name))], *rows], '<mergeCells><mergeCell ref="A1:D1"/></mergeCells>'),
        "xl/worksheets/sheet2.xml": sheet_xml([[text.format(escape(x))] for x in orders.o_orderstatus]),
    })


def letter(name: str, parts: pd.DataFrame) -> bytes:
    """A heading, a paragraph for each part, and a table of brands and sizes."""
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    body = p.format(escape(f"I. {name}")) + "".join(p.format(escape(f"  {n}  \t{t}")) for n, t in zip(parts.p_name, parts.p_type, strict=True))
    rows = "".join(f"<w:tr><w:tc>{p.format(escape(b))}</w:tc><w:tc>{p.format(s)}</w:tc></w:tr>" for b, s in zip(parts.p_brand, parts.p_size, strict=True))
    return packed_file({"word/document.xml": f"<w:document {W}><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>"})


def write_files(rows: DataFrame, root: str, order: str, build: Callable[[str, pd.DataFrame], bytes]) -> None:
    """A file below root for each value of `file`, whose rows are few, written by the task that has them. Rows are dealt over as
    many tasks as a shuffle has: they are little to move, and much to write."""

    def put(group: pd.DataFrame) -> pd.DataFrame:
        name = group.file.iloc[0]
        fs, base = scan.store(root)
        fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
        data = build(name, group.sort_values(order))
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
        return pd.DataFrame({"size": [len(data)]})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "file").groupBy("file").applyInPandas(put, "size long").agg(F.sum("size")).collect()


@query(f"""WITH numbered AS (SELECT 'orders/w' || CAST(o_orderkey // {ORDERS} AS VARCHAR) || '.xlsx' AS file, *, CAST(row_number() OVER (PARTITION BY o_orderkey // {ORDERS} ORDER BY o_orderkey) AS INTEGER) AS n FROM orders),
    parted AS (SELECT 'parts/d' || CAST(p_partkey // {PARTS} AS VARCHAR) || '.docx' AS file, *, CAST(row_number() OVER (PARTITION BY p_partkey // {PARTS} ORDER BY p_partkey) AS INTEGER) AS n FROM part),
    cells AS (SELECT file, 'orders' AS sheet, n + 1 AS row, unnest([1, 2, 3, 4]) AS col,
            unnest([CAST(o_orderkey AS VARCHAR), o_orderpriority, CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d 00:00:00')]) AS value FROM numbered
        UNION ALL SELECT DISTINCT file, 'orders', 1, 1, file FROM numbered
        UNION ALL SELECT file, 'states', n, 1, o_orderstatus FROM numbered),
    blocks AS (SELECT DISTINCT file, 0 AS block_index, 'I. ' || file AS value FROM parted
        UNION ALL SELECT file, n, p_name || ' ' || p_type FROM parted
        UNION ALL SELECT file, CAST(count(*) + 1 AS INTEGER), string_agg('Dòng ' || n || ': Ô 1: ' || p_brand || ' | Ô 2: ' || p_size, chr(10) ORDER BY n) FROM parted GROUP BY file)
    SELECT 'cell' AS kind, file AS relative_path, NULL AS section, CAST(NULL AS INTEGER) AS block_index, sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(NULL AS INTEGER) AS last_row, CAST(NULL AS INTEGER) AS last_col, value FROM cells
    UNION ALL SELECT DISTINCT 'merged', file, NULL, NULL, 'orders', 1, 1, 1, 4, NULL FROM numbered
    UNION ALL SELECT 'block', file, 'I. ' || file, block_index, NULL, NULL, NULL, NULL, NULL, value FROM blocks""")
def office_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and merged ranges of workbooks and blocks of letters from one scan. The files are made of all orders and parts."""
    root = new_path(spark, "office")
    name = lambda folder, key, rows, suffix: F.concat(F.lit(folder), F.floor(F.col(key) / rows).cast("string"), F.lit(suffix)).alias("file")
    write_files(table(spark, sf_dir, "orders").select(name("orders/w", "o_orderkey", ORDERS, ".xlsx"), "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderstatus"), root, "o_orderkey", workbook)
    write_files(table(spark, sf_dir, "part").select(name("parts/d", "p_partkey", PARTS, ".docx"), "p_partkey", "p_name", "p_type", "p_brand", "p_size"), root, "p_partkey", letter)
    rows = scan.scan(spark, root, required="true", rowblocks="false")
    wanted = rows.where(F.col("kind").isin("cell", "merged", "block", "error"))
    return wanted.select("kind", "relative_path", "section", "block_index", "sheet", "row", "col", "last_row", "last_col", F.coalesce("value", "text", "error").alias("value"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> clustered.Clustered:
    """All chunks, clustered by file at their first use in a session: a bucket for each 64 MB of files, 32 at least."""
    source = f"{sf_dir}/documents.parquet"
    buckets = max(32, bytes_of(spark, [source]) >> 26)
    write = lambda path: clustered.write_clustered(chunk_view(spark, sf_dir), path, "file_id", "chunk_index", buckets)
    return clustered.read_clustered(spark, built_once(spark, "clustered", [source], write))


@query("""WITH sizes AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
    chosen AS (SELECT DISTINCT source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM sizes WHERE source IS NOT NULL) WHERE r = 1)
    SELECT source AS file_id, doc_id AS chunk_index, md5(text) AS text_md5 FROM documents JOIN chosen USING (source) WHERE doc_id % 10 < 8""")
def clustered_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prose chunks of the chosen files, here the largest one of each language: the clustered chunks stay where they are."""
    sizes = table(spark, sf_dir, "documents").where("source is not null").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.groupBy("lang").agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("file_id"))
    rows = clustered.of_keys(stored_chunks(spark, sf_dir), chosen.select("file_id")).where("file_type in ('docx', 'pdf')")
    return rows.select("file_id", "chunk_index", F.md5(F.col("document").cast("binary")).alias("text_md5"))


@query(f"""WITH {CHUNKS}, least AS (SELECT min(file_id) AS file_id FROM chunks)
    SELECT file_id, chunk_index, file_type, md5(document) AS text_md5 FROM chunks JOIN least USING (file_id)""")
def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point scan: the chunks of one file, the first by its id. Only the buckets that may hold it are opened."""
    stored = stored_chunks(spark, sf_dir)
    least = stored.rows.agg(F.min("file_id")).first()[0]
    rows = clustered.lookup(stored, [] if least is None else [least])
    return rows.select("file_id", "chunk_index", "file_type", F.md5(F.col("document").cast("binary")).alias("text_md5"))
