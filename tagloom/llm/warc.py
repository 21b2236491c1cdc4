"""WARC archives of pages, with revisit records for payloads that occur more than once.

Only headers (page_id, digests, length) are shuffled by digest to find each payload's
original. Pages that are no revisits are written where they were read; the revisit
records are made from headers alone, with fresh headers that refer to their originals.
Spark's text writer joins the records with the separator that WARC asks for, so that every
file is an archive by itself, in the shared store and with Spark's commit of tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 1000
#: Records in one archive file at most, and the most bytes of their payloads unless one has more
#: by itself: one task reads a file whole. Bands of sizes grow by this factor.
FILE_RECORDS, FILE_BYTES, BAND = 2000, 1 << 28, 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, sha1 and digest (SHA-256, by which payloads are told apart)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"), F.unhex(F.sha2(payload, 256)).alias("digest"))


def record_id(page: Column, digest: Column) -> Column:
    """A name-based UUID of page and payload: a rewrite gives the same id."""
    h = F.md5(F.concat_ws(":", page.cast("string"), F.hex(digest)))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _head(kind: str, fields: list[tuple[str, Column]], block_bytes: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in fields:  # a null value leaves its line out; line ends inside are encoded
        safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), block_bytes.cast("string"), F.lit("\r\n\r\n"))


def _common(url: str, sha1: str, page: str, digest: str) -> list[tuple[str, Column]]:
    return [("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col(page), F.col(digest)), F.lit(">"))), ("Page-Id", F.col(page).cast("string")), ("WARC-Target-URI", F.col(url)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col(sha1)))]


def responses(pages: DataFrame) -> DataFrame:
    """One text record for each row of page_id, url, html, sha1, digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    fields = [*_common("url", "sha1", "page_id", "digest"), ("Content-Type", F.lit("application/http; msgtype=response"))]
    return pages.select(F.concat(_head("response", fields, F.octet_length(http) + F.octet_length(payload)), http, payload).alias("value"))


def revisits(rows: DataFrame) -> DataFrame:
    """One text record for each row of page_id, url, sha1, digest, refers_to, refers_url."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    fields = [*_common("url", "sha1", "page_id", "digest"), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("digest")), F.lit(">"))), ("WARC-Refers-To-Target-URI", F.col("refers_url")), ("WARC-Refers-To-Date", F.lit(DATE)), ("Content-Type", F.lit("application/http; msgtype=response"))]
    return rows.select(F.concat(_head("revisit", fields, F.octet_length(http)), http).alias("value"))


def bands(file_records: int, file_bytes: int = FILE_BYTES) -> list[tuple[int, int | None, int]]:
    """(least bytes, bytes that are too many, records a file): payloads of a band fill no file
    beyond file_bytes; those of the last have a file each."""
    out, least, top = [], 0, max(1, file_bytes // file_records)
    while top <= file_bytes:
        out.append((least, top + 1, min(file_records, file_bytes // top)))
        least, top = top + 1, top * BAND
    return [*out, (least, None, 1)]


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS, compression: str = "none", file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as archives below path.

    Payloads are written by bands of their sizes, each with as many records a file as file_bytes
    have room for; a band that no payload is in costs nothing, any other one look at the pages.

    Of equal payloads of least_bytes or more, the row with the largest page_id is the
    response, the others revisit it; smaller payloads are all responses. A null html is an
    empty payload, a null url leaves out the header, and a row without a page_id is a response. Rows that repeat page_id and payload
    give the same record each time. No rows give no records.
    """
    head = common.staged(headers(pages), "headers")
    best = F.max(F.struct("page_id", "url"))
    same = head.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(best.alias("best"), F.count("*").alias("rows")).where("rows > 1")
    same = common.staged(same.select("digest", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"), "rows"), "originals")
    total = head.count()
    again = common.lookup(head, same, "digest", "rows", total).where("page_id != refers_to")
    keyed = pages.select("page_id", "url", "html").withColumns({"sha1": F.sha1(F.coalesce("html", F.lit("")).cast("binary")), "digest": F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))})
    may = common.bit_filter(same, "digest")
    hits = keyed.where(may).join(again.select("page_id", "digest").distinct(), ["page_id", "digest"], "left_anti").select(keyed.columns)
    first = keyed.where(~may).unionByName(hits)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    within = lambda c, least, over: (c >= least) & (F.lit(True) if over is None else c < over)
    cuts = bands(file_records, file_bytes)
    there = head.agg(*(F.count_if(within(F.col("payload_bytes"), *cut[:2])) for cut in cuts)).first()
    for k, (least, over, records) in enumerate(cuts):
        if k and not there[k]:
            continue
        some = responses(first.where(within(size, least, over)))
        if not k:
            some = some.unionByName(revisits(again))
        some.write.mode("append" if k else "errorifexists").options(lineSep="\r\n\r\n", maxRecordsPerFile=records, compression=compression).text(path)


READ = "record_id string, page_id long, url string, record_type string, refers_record string, payload_bytes long, payload_digest string"


def _records(content: bytes):
    """(fields, block) of each record of an archive, compressed in one member or in many, or not."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at, view = 0, memoryview(content)
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name: value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        n = int(fields["Content-Length"])
        yield fields, view[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _parsed(batches):
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in _records(content.as_py()):
                response, size, digest = fields["WARC-Type"] == "response", None, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                if response:
                    data = bytes(block)
                    payload = data[data.index(b"\r\n\r\n") + 4 :]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
                rows.append((fields["WARC-Record-ID"], int(fields["Page-Id"]) if "Page-Id" in fields else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], fields.get("WARC-Refers-To"), size, digest))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)


def read(spark, path: str) -> DataFrame:
    """The records of the archives below path; a response's payload is measured, a revisit has
    the digest of its header, and no size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return common.mapped(files.select("content"), _parsed, READ)


def resolved(records: DataFrame) -> DataFrame:
    """records with each revisit joined to the response that it refers to.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit whose response
    is in no archive has its own digest, and null payload_bytes and refers_to.
    """
    records = common.staged(records, "records")
    first = records.where("record_type = 'response'")
    asks = records.where("record_type = 'revisit'").select("page_id", F.col("payload_digest").alias("own"), F.col("refers_record").alias("record_id"))
    counts = asks.groupBy("record_id").agg(F.count("*").alias("rows"))
    found = first.join(counts, "record_id").groupBy("record_id").agg(*(F.first(c).alias(c) for c in ("payload_bytes", "payload_digest", "rows")), F.first("page_id").alias("refers_to"))
    back = common.lookup(asks, found, "record_id", "rows", records.count(), "left").withColumn("payload_digest", F.coalesce("payload_digest", "own"))
    none = F.lit(None).cast("long")
    return first.select("page_id", "payload_bytes", "payload_digest", "record_type", none.alias("refers_to")).unionByName(back.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, **options) -> DataFrame:
    """Writes pages to new archives in the shared folder, and reads them back resolved."""
    path = common.scratch(pages.sparkSession, "warc")
    write(pages, path, least_bytes, **options)
    return resolved(read(pages.sparkSession, path))
