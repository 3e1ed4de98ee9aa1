"""WARC archives: writing captures, reading them back and joining each capture's records.

A capture is three records: request, response (or revisit, when an earlier page holds the same
payload) and metadata; request and metadata name the response in ``WARC-Concurrent-To``.  Records
are text, so Spark's text writer with the record separator as its line separator writes valid
WARC/1.1 files, each gzipped, to any store; ``binaryFile`` reads them back.

Of pages with equal payloads of at least ``min_revisit_bytes``, that with the least id is the
response.  The least id per digest is found by a partial aggregate and joined back, so a payload that
a third of the pages share is an ordinary skewed join key.

Edge cases: a null html is an empty payload (a response); a null url is written as an empty target;
rows without an id are left out; repeated rows of one id are written, and read, as often as they occur.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to_record string, target_uri string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def record_id(kind: str, page: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), page.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers whose value is null are left out.  The separator after the block is the writer's."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise(F.lit("")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, length, block)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 100, captures_per_file: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    base = pages.select(pages[id_col].cast("long").alias("page_id"), F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"))
    base = base.where("page_id is not null").withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "n": F.octet_length("html").cast("long")})
    first = base.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    base = base.join(first.drop("copies"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("page_id"))
    page, url = F.col("page_id"), F.col("url")
    main_id, when = record_id("response", page), F.lit(date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    main = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main_id),
            ("WARC-Date", when),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha-256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, record_id("response", F.col("first_id")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    path_part = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", record_id("request", page)),
            ("WARC-Date", when),
            ("WARC-Target-URI", url),
            ("WARC-Concurrent-To", main_id),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.when(path_part == "", "/").otherwise(path_part), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    notes = [F.concat(F.lit("page-id: "), page.cast("string")), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string"))]
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", record_id("metadata", page)),
            ("WARC-Date", when),
            ("WARC-Target-URI", url),
            ("WARC-Concurrent-To", main_id),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat_ws(CRLF, *notes),
    )
    records = base.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, each with its headers in lower case and its block."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        at = begin + int(headers["content-length"])
        if at > len(data):
            raise ValueError("a record is cut off")
        yield headers | {"block": data[begin:at]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    for batch in batches:
        for data in batch.column(0):
            rows = []
            raw = data.as_py()
            for r in parse_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                kind, block, fields = r["warc-type"], r["block"], {}
                digest = r.get("warc-payload-digest", "").rpartition(":")[2] or None
                payload = None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{r['warc-record-id']}: the payload does not fit its digest")
                elif kind == "metadata":
                    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split(CRLF))}
                rows.append((r["warc-record-id"], kind, r.get("warc-concurrent-to"), r.get("warc-refers-to"), r.get("warc-target-uri"), digest, None if payload is None else len(payload), payload, list(fields.items())))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > 0).select("content").mapInArrow(_rows, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit with its ``request`` and ``metadata`` records nested.

    A revisit has the metadata of the capture that its ``WARC-Refers-To`` names as ``original``, null if the archives
    lack it.  A capture whose request or metadata record is missing keeps a null there; of several request or
    metadata records for one response, the one with the greatest identifier counts.
    """
    main = records.where(F.col("record_type").isin("response", "revisit")).drop("concurrent_to", "fields")
    of = lambda kind, *cols: records.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.max(F.struct("record_id", *cols)).alias(kind))
    meta = records.where(F.col("record_type") == "metadata").groupBy(F.col("concurrent_to").alias("record_id"))
    meta = meta.agg(F.max(F.struct("record_id", *(F.col("fields")[k].alias(k.replace("-", "_")) for k in ("page-id", "payload-bytes")))).alias("metadata"))
    # Only originals that are named go on, and only their metadata, however many captures revisit one.
    named = main.where("refers_to_record is not null").select(F.col("refers_to_record").alias("record_id")).distinct()
    originals = meta.join(named, "record_id", "left_semi").toDF("refers_to_record", "original")
    whole = main.join(of("request", "target_uri"), "record_id", "left").join(meta, "record_id", "left")
    return whole.join(originals, "refers_to_record", "left")
