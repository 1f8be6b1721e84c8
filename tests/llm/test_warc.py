import hashlib

import pytest

from lumenbase.llm.common import fresh_path
from lumenbase.llm.warc import archive, read_back, read_records, write_archive

LONG, DDL = "é" * 60 + "x", "page_id long, url string, html string, digest int"
ROWS = [(3, "u3", LONG), (1, "u1", LONG), (7, None, LONG), (2, "a\r\nWARC-Record-ID: <urn:page:99>", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (8, "u8", "y" * 99), (9, "u9", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (None, "u", "z" * 100), (11, "u", "z" * 100)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], DDL)


def brute(rows):
    payload = {i: (h or "").encode() for i, _, h in rows if i is not None}
    out = []
    for i, p in sorted(payload.items()):
        first = min(j for j, q in payload.items() if q == p)
        revisit = len(p) >= 100 and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip(spark):
    path = fresh_path(spark, "archive")
    write_archive(pages(spark, ROWS), path)
    assert sorted(map(tuple, read_back(spark, path).collect())) == brute(ROWS)
    html = {i: (h or "").encode() for i, _, h in ROWS}
    records = {r["page_id"]: r for r in read_records(spark, path).collect()}
    assert {i: bytes(r["payload"]) for i, r in records.items()} == {i: h for i, h in html.items() if i is not None}
    for i, r in records.items():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Record-ID"] == f"<urn:page:{i}>"
        want = html[i] if r["record_type"] == "response" else b""
        assert body == want + b"\r\n\r\n" and int(fields["Content-Length"]) == len(want)
        assert ("WARC-Refers-To" in fields) == ("WARC-Profile" in fields) == (r["record_type"] == "revisit")
        assert fields["WARC-Date"] == "1970-01-01T00:00:00Z"
    assert spark.read.parquet(f"{path}/payloads").count() == len(set(html.values()))


def test_a_changed_payload_is_noticed(spark):
    path = fresh_path(spark, "archive")
    write_archive(pages(spark, ROWS), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "length", "cast('other' as binary) as payload")
    bad.write.parquet(f"{path}/bad")
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/bad", f"{path}/payloads")
    with pytest.raises(Exception, match="doesn't give its digest"):
        read_back(spark, path).collect()


@pytest.mark.parametrize(("old", "new", "error"), [("(Content-Length: )", "$19", "isn't of its Content-Length"), ("sha256:[0-9a-f]{4}", "sha256:0000", "doesn't give its digest")])
def test_a_changed_header_is_noticed(spark, old, new, error):
    path = fresh_path(spark, "archive")
    write_archive(pages(spark, ROWS), f"{path}/good")
    for name, column in (("payloads", "payload"), ("headers", f"regexp_replace(header, '{old}', '{new}') as header")):
        rows = spark.read.parquet(f"{path}/good/{name}")
        rows.selectExpr(*[c for c in rows.columns if c not in ("payload", "header")], column).write.parquet(f"{path}/{name}")
    with pytest.raises(Exception, match=error):
        read_back(spark, path).collect()


def test_very_long_payloads(spark):
    rows = [(1, "u", "é" * 3_000_000), (2, "v", "é" * 3_000_000), (3, "w", "x" * 5_000_000)]
    assert sorted(map(tuple, archive(pages(spark, rows)).collect())) == brute(rows)


def test_empty(spark):
    assert archive(pages(spark, [])).collect() == []
