"""Archive files: records by offset and length, whole files by ranges, and what is broken."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from curavine.sources import archive, web

PAGES = [(k, f"https://x.example/{k}", f"<p>page {k} é 日</p>" + "lorem ipsum " * (k * 40)) for k in range(60)]


def record(url, html, status="200 OK", kind="response"):
    http = f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\n\r\n{html}"
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n\r\n{http}".encode())


@pytest.fixture
def folder(tmp_path):
    """Two archives and their index; the second has a broken record in its middle and ends within one."""
    (tmp_path / "a").mkdir()
    index = []
    for name, rows in (("a/one.warc.gz", PAGES[:40]), ("two.warc.gz", PAGES[40:])):
        data = b""
        for k, url, html in rows:
            member = record(url, html)
            index.append((k, url, name, len(data), len(member)))
            data += member
        if name == "two.warc.gz":
            at = index[45][3]
            data = data[: at + 30] + b"\0" * 20 + data[at + 50 :]
            data = data[:-7]
        (tmp_path / name).write_bytes(data)
    return str(tmp_path), index


INDEX = "id long, url string, filename string, offset long, length long"
GOOD = {k for k, *_ in PAGES} - {45, 59}


def test_records_by_offset_and_length(spark, folder):
    path, index = folder
    odd = [(100, "u", "a/one.warc.gz", None, 10), (101, "u", "a/one.warc.gz", 0, 0), (102, "u", "none.gz", 0, 10), (103, "u", None, 0, 10), (104, "u", "a/one.warc.gz", 10**9, 10), (105, "u", "a/one.warc.gz", 0, 20), (106, "u", "a/one.warc.gz", -1, 20), (7, *index[7][1:])]
    df = spark.createDataFrame(index + odd, INDEX).repartition(5)
    for size in (1, 3000, 64_000_000):
        got = sorted(((r.id, r.body) for r in archive.archived(df, path, range_bytes=size).collect()), key=str)
        want = [(k, html if k in GOOD else None) for k, _, html in PAGES] + [(k, None) for k in range(100, 107)] + [(7, PAGES[7][2])]
        assert got == sorted(want, key=str)
    assert archive.archived(df.limit(0), path).count() == 0


def test_index_lines_lead_to_bodies(spark, folder):
    path, index = folder
    lines = [json.dumps({"url": u, "mime": "text/html", "status": "200", "filename": f, "offset": str(o), "length": str(n)}) for _, u, f, o, n in index] + ["no json", "{}"]
    rows = web.index_records(spark.createDataFrame([(x,) for x in lines], "value string")).drop("value")
    got = archive.archived(rows, f"file://{path}", "r_filename", "r_offset", "r_length")
    assert {r.r_url: r.body for r in got.collect()} == {u: h if k in GOOD else None for k, u, h in PAGES}


def test_whole_archives_in_ranges(spark, folder):
    path, index = folder
    archive.register(spark)
    for size in (500, 4096, 10**8):
        df = spark.read.format("curavine_archive").option("rangeBytes", size).load(path)
        rows = df.collect()
        assert sorted((r.file, r.offset, r.length, r.url, r.body, r.status, r.mime, r.kind) for r in rows if r.length) == sorted(
            (f, o, n, u, PAGES[k][2], 200, "text/html", "response") for k, u, f, o, n in index if k in GOOD)
        assert {(r.file, r.offset, r.body) for r in rows if r.length is None} <= {(f, o, None) for k, _, f, o, _ in index if k not in GOOD}
        assert df.rdd.getNumPartitions() == sum(-(-sum(n for _, _, f, _, n in index if f == name) // size) for name in ("a/one.warc.gz", "two.warc.gz")) or size == 500


def test_filters_leave_out_ranges(spark, folder):
    path, index = folder
    archive.register(spark)
    df = spark.read.format("curavine_archive").option("rangeBytes", 1000).load(path)
    every = df.rdd.getNumPartitions()
    one = df.where("file = 'a/one.warc.gz'")
    assert one.count() == 40 and one.rdd.getNumPartitions() < every
    at = index[20][3]
    found = df.where(F.col("file").isin("a/one.warc.gz", "x") & (F.col("offset") >= at) & (F.col("offset") < at + 1))
    assert [r.url for r in found.collect()] == [index[20][1]] and found.rdd.getNumPartitions() <= 2
    assert df.where("file = 'nothing'").count() == 0 and df.where("offset = 0").count() == 2
    assert df.where("status = 404").count() == 0


def test_records_without_pages(tmp_path):
    data = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nno answer") + gzip.compress(b"something else") + record("u", "", "404 Not Found", "response") + b"trailing"
    (tmp_path / "x.gz").write_bytes(data)
    source = archive._opened(str(tmp_path / "x.gz"))
    rows = [archive.parsed(raw) for _, _, raw in archive.members(source, 0, len(data))]
    assert [(r["kind"], r["status"], r["body"]) for r in rows] == [("warcinfo", None, None), ("response", 404, "")]


def test_written_pages_come_back(spark, tmp_path):
    pages = spark.createDataFrame([*PAGES, (60, None, None), (61, "https://x.example/é", "\r\n\r\n")], "page_id long, url string, html string").repartition(4)
    index = spark.createDataFrame(archive.write_archive(pages, f"file://{tmp_path}/w").collect())
    got = archive.archived(index, f"{tmp_path}/w")
    assert {r.page_id: r.body for r in got.collect()} == {k: h for k, _, h in PAGES} | {60: "", 61: "\r\n\r\n"}
