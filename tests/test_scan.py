"""The office data source, and tables clustered for lookups."""

import re

import pytest
from pyspark.sql import functions as F

from lumenbase.sources import clustered, office, scan
from tests.test_engine import docx, xlsx


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b").mkdir()
    for name, data in (("a.docx", docx()), ("b/T.XLSX", xlsx()), ("bad.xlsx", b"no zip"), ("~$a.docx", docx()), ("n.txt", b"x"), ("p.pdf", b"one")):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


@pytest.fixture
def pruning(spark):
    spark.conf.set(scan.PUSHDOWN, "true")
    yield
    spark.conf.unset(scan.PUSHDOWN)


@pytest.mark.parametrize("pushed", [False, True])
def test_scan_gives_what_the_readers_give(spark, folder, pushed, request):
    if pushed:
        request.getfixturevalue("pruning")
    rows = scan.scan(spark, folder, every="true")
    files = office.discover(spark, folder, every=True)
    as_set = lambda df: sorted(map(str, df.collect()))
    listing = ["file_id", "source", "relative_path", "file_type", "size_bytes"]
    assert as_set(rows.where("kind = 'file'").select(listing)) == as_set(files.select(listing))
    assert as_set(scan.blocks(rows)) == as_set(office.read_files(files))
    assert as_set(scan.cells(rows)) == as_set(office.good(office.read_cells(files)))
    assert as_set(scan.merged(rows)) == as_set(office.good(office.read_merged(files)))
    assert as_set(rows.where("kind in ('block', 'cell') and file_type = 'xlsx' and row > 1").select("kind", "value")) == as_set(
        spark.createDataFrame([("block", None), ("cell", "chung"), ("cell", "5")], "kind string, value string"))
    assert rows.where("kind = 'cell' and relative_path like 'b/%' and file_type is not null").count() == 4
    assert rows.where("kind = 'other'").count() == 0


def test_each_file_is_opened_once_and_only_if_asked(folder, monkeypatch):
    opened = []
    plain = scan.OfficeReader.opened
    monkeypatch.setattr(scan.OfficeReader, "opened", lambda self, f: opened.append(f.relative_path) or plain(self, f))

    def read(*filters):
        opened.clear()
        reader = scan.PruningReader({"path": folder})
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return rows, left

    rows, _ = read()
    assert sorted(opened) == ["a.docx", "b/T.XLSX", "bad.xlsx", "p.pdf"]
    assert {r["kind"] for r in rows} == set(scan.KINDS)
    rows, left = read(scan.EqualTo(("kind",), "file"))
    assert not opened and not left and [r["relative_path"] for r in rows] == ["a.docx", "b/T.XLSX", "bad.xlsx", "p.pdf"]
    _, left = read(scan.In(("file_type",), ("docx", "pptx")), scan.EqualTo(("row",), 1))
    assert opened == ["a.docx"] and left == [scan.EqualTo(("row",), 1)]
    read(scan.StringStartsWith(("relative_path",), "b/"))
    assert opened == ["b/T.XLSX"]
    rows, _ = read(scan.EqualTo(("file_id",), rows[0]["file_id"]), scan.EqualTo(("kind",), "error"))
    assert opened == ["a.docx"] and not rows


def test_files_are_dealt_by_size():
    file = lambda n: scan.Found("", "", "", "", "docx", n, None)
    sizes = [[f.size_bytes for f in p.files] for p in scan.dealt(map(file, [5, 4, 30, 1, 1, 1, 9]), 12, 1)]
    assert sizes == [[5, 4], [30], [1, 1, 1], [9]] and scan.dealt([], 12, 1) == []


def test_missing_and_empty_directories(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan.OfficeReader({"path": str(tmp_path / "none")}).partitions()
    with pytest.raises(Exception, match="no such directory"):
        scan.scan(spark, str(tmp_path / "none")).count()
    assert scan.scan(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no office files"):
        scan.scan(spark, str(tmp_path), required="true").count()


def test_a_fault_in_the_middle_leaves_no_rows_of_the_file(spark, tmp_path):
    data = xlsx().replace(b"</worksheet>", b"<//worksheet")
    (tmp_path / "t.xlsx").write_bytes(data)
    got = scan.scan(spark, str(tmp_path)).groupBy("kind").agg(F.count("*").alias("n")).collect()
    assert sorted((r["kind"], r["n"]) for r in got) == [("error", 1), ("file", 1)]


def made(spark, tmp_path, name="one", buckets=8):
    """A thousand rows, a third of them of one key, and some without a key."""
    key = F.when(F.col("n") % 3 == 0, "hot").when(F.col("n") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("n") % 40).cast("string")))
    rows = spark.range(1000).withColumnRenamed("id", "n").select(key.alias("file_id"), "n", (F.col("n") * 2).alias(f"{name}_value"))
    clustered.write_clustered(rows, str(tmp_path / name), "file_id", "n", buckets=buckets, parts=4)
    return rows, clustered.read_clustered(spark, str(tmp_path / name))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_opens_the_buckets_of_its_key(spark, tmp_path):
    rows, stored = made(spark, tmp_path, buckets=32)
    as_set = lambda df: sorted(map(str, df.select("file_id", "n", "one_value").collect()))
    assert as_set(stored.rows) == as_set(rows)
    for wanted in (["k7"], ["hot"], [None], ["k7", None, "absent"], ["absent"], []):
        test = F.col("file_id").isin(*[w for w in wanted if w]) if any(wanted) else F.lit(False)
        got = clustered.lookup(stored, wanted)
        assert as_set(got) == as_set(rows.where(test | F.col("file_id").isNull() if None in wanted else test)), wanted
    hot = clustered.lookup(stored, ["hot"]).select(F.input_file_name()).distinct().count()
    assert hot > 1  # a key with a third of the rows isn't one task
    places = spark.range(4).select(F.pmod(F.hash(clustered.place_of(F.lit("k7"), F.col("id"))), F.lit(32)).alias("b"))
    buckets = {r.b for r in places.collect()}
    want, others = as_set(clustered.lookup(stored, ["k7"])), 0
    for file in (tmp_path / "one" / "rows").glob("part-*"):
        if int(re.search(r"_(\d{5})\.", file.name).group(1)) not in buckets:
            file.write_bytes(b"x" * file.stat().st_size)
            others += 1
    assert others > 20 and as_set(clustered.lookup(stored, ["k7"])) == want  # none of the others was opened
    with pytest.raises(Exception, match="(?i)parquet"):
        stored.rows.collect()


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_a_join_leaves_clustered_rows_where_they_are(spark, tmp_path, partitions):
    rows, stored = made(spark, tmp_path)
    keys = spark.createDataFrame([("k7",), ("k7",), ("hot",), (None,)], "file_id string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        chosen = clustered.of_keys(stored, keys)
        assert sorted(r.n for r in chosen.collect()) == sorted(r.n for r in rows.where("file_id in ('k7', 'hot')").collect())
        table_side = plan(clustered.of_keys(stored, keys)).split("FileScan")[0]
        assert "SortMergeJoin" in table_side and "Exchange" not in table_side  # the clustered scan stands first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert clustered.of_keys(stored, keys.limit(0)).count() == 0


def test_an_empty_table_is_clustered(spark, tmp_path):
    rows, _ = made(spark, tmp_path)
    clustered.write_clustered(rows.limit(0), str(tmp_path / "none"), "file_id", "n", buckets=2)
    stored = clustered.read_clustered(spark, str(tmp_path / "none"))
    assert stored.rows.count() == clustered.lookup(stored, ["hot"]).count() == 0


def test_rows_of_workbooks_without_blocks(folder, spark):
    """Where only cells are asked for, no row of a workbook is put together as a block; all else stays."""
    every, bare = (scan.scan(spark, folder, **options).select("kind", "relative_path", "row", "col", "value", "text") for options in ({}, {"rowblocks": "false"}))
    want = [r for r in every.collect() if r["kind"] != "block" or not r["relative_path"].lower().endswith("xlsx")]
    assert sorted(map(str, bare.collect())) == sorted(map(str, want)) and len(want) < every.count()
