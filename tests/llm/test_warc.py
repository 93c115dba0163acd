import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skytally.llm import warc


def report(spark, pages):
    return warc.page_report(warc.assemble(warc.read_archives(spark, warc.write_archives(pages))))


def test_sql(spark, tables, duck, same):
    same(report(spark, spark.read.parquet(f"{tables}/pages.parquet")), duck, warc.ORACLE_SQL)


def test_edges(spark):
    big, tricky = "é" * 600, "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 40
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "", None), (5, "http://b", ""), (6, "http://c", tricky), (7, "http://d", tricky), (None, "http://e", big), (8, "s", "short"), (9, "s", "short"), (9, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = report(spark, pages).collect()
    assert len(got) == len(rows)
    size = {1: big, 2: big, 3: big, 4: "", 5: "", 6: tricky, 7: tricky, None: big, 8: "short", 9: "short"}
    for r in got:
        data = size[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        want = {1: 3, 2: 3, 6: 7}.get(r.page_id)
        assert r.refers_to == want and r.record_type == ("revisit" if want else "response")


def test_repeated_rows_refer_to_the_last_page(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1000), (1, "u", "x" * 1000), (2, "u", "x" * 1000), (2, "u", "x" * 1000)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in report(spark, pages).collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]


def test_revisits_name_what_they_refer_to(spark, tmp_path):
    """In the standard's own headers, which the reader gives back; a response without a URL can't be named by one."""
    long, other = "y" * 1500, "z" * 1500
    pages = spark.createDataFrame([(1, "http://a/1", long), (2, "http://b/2\n?x", long), (3, "http://c", other), (4, None, other)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    headers = [h for f in Path(tmp_path, "w").glob("*.gz") for h, _ in warc.records_of(f.read_bytes())]
    revisits = {h["warc-target-uri"]: h for h in headers if h["warc-type"] == "revisit"}
    assert revisits["http://a/1"]["warc-refers-to-target-uri"] == "http://b/2%0A?x" and revisits["http://a/1"]["warc-refers-to-date"] == "2024-01-01T00:00:00Z"
    assert "warc-refers-to-target-uri" not in revisits["http://c"] and len(revisits) == 2
    rows = warc.assemble(warc.read_archives(spark, path)).where("response.type = 'revisit'").collect()
    assert {r.response.refers_to_uri for r in rows} == {"http://b/2%0A?x", None}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert report(spark, pages).count() == 0


def test_nested_captures_and_files(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(k, f"http://h/{k}?q", f"<p>{k}</p>") for k in range(25)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, path, captures_per_file=10)
    files = sorted(Path(tmp_path, "w").glob("*.gz"))
    assert len(files) == 3
    kinds = [h["warc-type"] for f in files for h, _ in warc.records_of(f.read_bytes())]
    assert [kinds.count(k) for k in ("request", "response", "metadata")] == [25, 25, 25]
    parts = gzip.decompress(files[0].read_bytes())
    assert [h for h, _ in warc.records_of(parts)] == [h for h, _ in warc.records_of(gzip.compress(parts[:0]) + gzip.compress(parts))]
    row = warc.assemble(warc.read_archives(spark, path)).first()
    assert row.request.concurrent_to == row.metadata.concurrent_to == row.capture_id == row.response.record_id and row.n_request == row.n_metadata == 1
    with pytest.raises(ValueError):
        list(warc.records_of(parts[:-30]))


def test_assembly_of_odd_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "x")], "page_id long, url string, html string")
    records = warc.read_archives(spark, warc.write_archives(pages, f"file://{tmp_path}/w"))
    doubled = records.union(records.where("type = 'request'"))
    row = warc.assemble(doubled).collect()
    assert len(row) == 1 and row[0].n_request == 2
    alone = warc.assemble(records.where("type = 'response'")).first()
    assert alone.request is None and alone.metadata is None and alone.n_request == 0
    assert warc.assemble(records.where("type = 'metadata'")).count() == 0


def test_members_are_read_in_a_stream():
    """Records larger than a step, gzipped each by itself, in halves and whole; what is cut short is an error."""
    blocks = [b"x" * 3_000_000, b"", b"WARC/1.1\r\n\r\n" * 9, bytes(range(256)) * 9000]
    made = [b"WARC/1.1\r\nWARC-Type: t%d\r\nContent-Length: %d\r\n\r\n" % (k, len(b)) + b + b"\r\n\r\n" for k, b in enumerate(blocks)]
    whole = b"".join(made)
    for data in (whole, gzip.compress(whole), b"".join(map(gzip.compress, made)), gzip.compress(whole[:100]) + gzip.compress(whole[100:]), gzip.compress(whole) + b"\0" * 9):
        assert [(h["warc-type"], b) for h, b in warc.records_of(data)] == [(f"t{k}", b) for k, b in enumerate(blocks)]
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(gzip.compress(b""))) == []
    for bad in (whole[:-20], gzip.compress(whole)[:-2000], b"no" + whole):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
