"""WARC archives: writing captures as request, response (or revisit) and metadata records, reading records, and assembling them.

Archives are written by Spark's own text writer, one record per line of text with a blank-line separator, so they reach any
file system that Spark reaches and a lost executor's task is simply run again. Every file is a valid (gzipped) WARC file.
Assembly joins the records of a capture through WARC-Concurrent-To.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm.common import work_path

CRLF = "\r\n"
RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to_uri string, content_type string, "
    "block_bytes long, payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>"
)


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column, date: str) -> Column:
    """The text of one record without the two line ends after its block; headers whose value is null are left out."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF)]
    head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, payload) with payload_bytes, payload_digest, refers_to and its URL, refers_to_url.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest page_id are responses and the others refer to
    it; a row with a null page_id is a response. The largest id of each payload is aggregated before the shuffle, and only
    payloads that occur twice are joined back, so a payload held by a third of all rows costs one row in the join; Spark splits
    its rows on the other side. The digest is joined by SHA-1 and length.
    """
    digest = F.sha1(F.col("payload").cast("binary"))
    rows = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest})
    long = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    last = (
        long.groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("last"), F.min("page_id").alias("first_id"))
        .where("first_id < last.page_id")
        .select("payload_digest", "payload_bytes", F.col("last.page_id").alias("last_id"), F.col("last.url").alias("last_url"))
    )
    joined = rows.join(last, ["payload_digest", "payload_bytes"], "left")
    earlier = F.col("page_id") < F.col("last_id")
    return joined.withColumns({"refers_to": F.when(earlier, F.col("last_id")), "refers_to_url": F.when(earlier, F.col("last_url"))}).drop("last_id", "last_url")


def write_archives(pages: DataFrame, path: str | None = None, *, date: str = "2024-01-01T00:00:00Z", captures_per_file: int = 10_000) -> str:
    """Write three records per row of ``pages`` (page_id, url, html) and return the folder.

    Null html is an empty payload and a null URL gives no target. Line ends in a URL are percent-encoded in its header. Repeated
    rows are separate captures: record ids are random, so a revisit names what it refers to by its URI and date. An empty table makes an empty folder; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    slim = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    ids = F.struct(*(F.format_string("<urn:uuid:%s>", F.uuid()).alias(k) for k in ("request", "response", "metadata")))
    rows = revisits(slim).withColumn("ids", ids)
    in_header = lambda url: F.nullif(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), F.lit(""))
    uri = in_header("url")
    host = F.regexp_extract(uri, "^[^:]*://([^/?#]*)", 1)
    target = F.nullif(F.regexp_extract(uri, "^[^:]*://[^/?#]*([^#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    notes = F.concat(
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.lit("payloadBytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF),
        F.coalesce(F.concat(F.lit("refersToPage: "), F.col("refers_to").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    common = [("WARC-Target-URI", uri)]
    concurrent = [*common, ("WARC-Concurrent-To", F.col("ids.response"))]
    digest = [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))]
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    profile = [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To-Target-URI", in_header("refers_to_url")), ("WARC-Refers-To-Date", F.lit(date))]
    request = _record("request", F.col("ids.request"), [*concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], asked, date)
    response = F.when(
        F.col("refers_to").isNull(), _record("response", F.col("ids.response"), [*digest, http], F.concat(head, "payload"), date)
    ).otherwise(_record("revisit", F.col("ids.response"), [*digest, *profile, http], head, date))
    metadata = _record("metadata", F.col("ids.metadata"), [*concurrent, ("Content-Type", F.lit("application/warc-fields"))], notes, date)
    (
        rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * captures_per_file)
        .text(path)
    )
    return path


def unzipped(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain or gzipped (whole or by record) file, a megabyte at a time."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[k : k + step]) for k in range(0, len(data), step))
        return
    at, one = 0, zlib.decompressobj(wbits=31)
    while at < len(data) or one.unconsumed_tail:
        if one.eof:
            # Past a member's end: the next one begins, or padding that is no member.
            if bytes(data[at : at + 2]) != b"\x1f\x8b":
                return
            one = zlib.decompressobj(wbits=31)
        part = one.unconsumed_tail or bytes(data[at : at + step])
        if not one.unconsumed_tail:
            at += len(part)
        yield one.decompress(part, step)
        at -= len(one.unused_data)
    yield one.flush()


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a WARC file, read in a stream; what follows a broken record is an error."""
    source, held, place = unzipped(memoryview(data)), bytearray(), 0

    def more() -> bool:
        for part in source:
            if part:
                held.extend(part)
                return True
        return False

    while True:
        skip = 0
        while held.startswith(b"\r\n", skip) or (len(held) - skip < 2 and more()):
            skip += 2 if held.startswith(b"\r\n", skip) else 0
        del held[:skip]
        place += skip
        if not held and not more():
            return
        while len(held) < 5 and more():
            pass
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError(f"a record at byte {place} is cut short")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(header["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError(f"a record at byte {place} is cut short")
        yield header, bytes(held[end + 4 : stop])
        del held[:stop]
        place += stop


def _row(header: dict[str, str], block: bytes) -> tuple:
    kind, digest = header.get("warc-type"), header.get("warc-payload-digest")
    named = digest.partition(":")[2] if digest else None
    fields, payload, own = [], None, None
    if header.get("content-type", "").startswith("application/warc-fields"):
        lines = block.decode("utf-8", "replace").split("\r\n")
        fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in lines) if s]
    elif kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        own = hashlib.sha1(payload).hexdigest()
    ok = None if own is None or named is None else own == named
    return (
        header.get("warc-record-id"), kind, header.get("warc-concurrent-to"), header.get("warc-target-uri"), header.get("warc-refers-to-target-uri"),
        header.get("content-type"), len(block), None if payload is None else len(payload), own or named, ok, dict(fields),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of every ``.gz`` or ``.warc`` file under ``path``, without the blocks; digests are recomputed from responses."""
    names = [c.strip().split(" ", 1)[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]
    map_type = pa.map_(pa.string(), pa.string())
    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string(), pa.bool_(), map_type]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for header, block in records_of(content.as_py()):
                    rows.append(_row(header, block))
                    if len(rows) == 10_000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([list(x.items()) for x in c] if t == map_type else list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path)
    return files.select("content").mapInArrow(work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_requests, n_metadata.

    A capture is a response or revisit record; the request and metadata records whose concurrent_to names it are joined to it.
    Of several of one kind (repeated records too) the one with the smallest record_id is nested and the number counted, before
    the shuffle, so that a much-named capture stays one row. Records that name no capture of the table, or have null ids, are
    left out; captures without a request or metadata have null there.
    """
    part = F.struct(*(c for c in records.columns))
    named = records.select(F.col("concurrent_to").alias("capture_id"), "record_id", "type", part.alias("part")).where("capture_id IS NOT NULL")
    captures = records.where("type IN ('response', 'revisit') AND record_id IS NOT NULL").select(F.col("record_id").alias("capture_id"), part.alias("response"))

    def side(kind: str) -> DataFrame:
        return named.where(F.col("type") == kind).groupBy("capture_id").agg(F.min_by("part", "record_id").alias(kind), F.count("*").alias(f"n_{kind}"))

    joined = captures.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("request", "metadata")]
    return joined.select("capture_id", "response", "request", "metadata", *counts)


def page_report(captures: DataFrame) -> DataFrame:
    """Per capture of ``write_archives``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    note = lambda k: F.col("metadata.fields")[k].cast("long")
    return captures.select(
        note("pageId").alias("page_id"),
        F.coalesce("response.payload_bytes", note("payloadBytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        note("refersToPage").alias("refers_to"),
        F.col("response.digest_ok").alias("digest_ok"),
    )


#: DuckDB SQL for ``page_report(assemble(read_archives(write_archives(pages))))``.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to,
  CASE WHEN page_id < last_id THEN NULL ELSE true END AS digest_ok
FROM q"""
