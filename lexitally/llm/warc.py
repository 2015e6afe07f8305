"""WARC archives with revisit records (operator 7).

Writing: every page gets a record.  Headers are shuffled by payload digest: the
smallest page_id of a digest keeps its payload as a ``response`` record, the
others become ``revisit`` records that name it and carry no payload.  The
archives are ordinary gzip files of records with fresh headers, written by
Spark's text writer (a record, then the blank lines that end it).

Reading: archives are parsed by Content-Length, so payloads may hold anything.
Revisit records are joined to the responses of their digest, which gives back
the size (and, if asked for, the payload) of what was left out.

Defined results: a null html is an empty payload; a null url writes no
target-URI header; rows with a null page_id are responses of their own and come
back with a null page_id; rows that repeat the smallest page_id of a digest are
responses too; an empty table writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Chunks

CRLF = "\r\n"
END = CRLF + CRLF
RECORDS_PER_ARCHIVE = 2000        # bounds the memory of a reader; archives grow in number
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DDL = ("record_id string, page_id bigint, record_type string, payload_digest string, refers_to bigint, "
              "url string, warc_date string, declared_bytes bigint, payload_bytes bigint, digest_ok boolean, "
              "payload binary")
RECORD_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()),
    ("declared_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()),
    ("payload", pa.binary())])


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: 40 hex digits in four groups of 40 bits, each 8 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html + payload_bytes, payload_digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", payload.alias("html"),
                        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
                        base32_sha1(payload.cast("binary")).alias("payload_digest"))
    # headers alone, aggregated before the shuffle; only digests that repeat matter
    firsts = (full.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
              .where("_first <> _last").drop("_last"))
    joined = full.join(firsts, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("_first"), F.col("_first"))).drop("_first")


def records(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """The text of one WARC record per row, without the blank lines that end it."""
    when = F.lit(date) if date else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), uri),                       # null without a url
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Write one record per page below ``path`` (gzip archives)."""
    (records(with_revisits(pages, min_bytes), date).write
     .option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path))


def parse(data: bytes):
    """(headers, block) of each record of an uncompressed archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = stop + 4
        size = int(headers["Content-Length"])
        yield headers, data[start:start + size]
        at = start + size + 4


def _page(urn: str | None) -> int | None:
    name = urn[len("<urn:page:"):-1] if urn else "none"
    return None if name == "none" else int(name)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives below ``path`` (columns of RECORD_DDL).

    ``digest_ok`` says whether a response's payload has the digest its header
    states; it is null for revisits.
    """

    def read(batches):
        out = Chunks(RECORD_SCHEMA)
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse(gzip.decompress(content.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = next((int(x[15:]) for x in head.split(b"\r\n")
                                     if x.lower().startswith(b"content-length:")), None)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    ok = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                    response = kind == "response"
                    yield from out.add(
                        (headers["WARC-Record-ID"], _page(headers["WARC-Record-ID"]), kind, digest,
                         _page(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), headers["WARC-Date"],
                         declared, len(payload) if response else None, ok if response else None,
                         payload if response and payloads else None), 300 + payloads * len(payload))
        yield from out.rest()

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.gz").load(path))
    return files.select("content").mapInArrow(read, RECORD_DDL)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Records with revisits completed from the responses of their digest.

    Joined on (digest, page of the response); adds ``resolved``, false for a
    revisit whose response is in none of the archives.
    """
    responses = found.where("record_type = 'response'")
    revisits = found.where("record_type = 'revisit'")
    originals = responses.select("payload_digest", F.col("page_id").alias("refers_to"),
                                 F.col("payload_bytes").alias("_bytes"), F.col("payload").alias("_payload"),
                                 F.col("digest_ok").alias("_ok")).dropDuplicates(["payload_digest", "refers_to"])
    done = (revisits.join(originals, ["payload_digest", "refers_to"], "left")
            .withColumn("resolved", F.col("_bytes").isNotNull())
            .withColumn("payload_bytes", F.coalesce("_bytes", "declared_bytes"))
            .withColumn("payload", F.col("_payload")).withColumn("digest_ok", F.col("_ok")))
    cols = [*found.columns, "resolved"]
    return responses.withColumn("resolved", F.lit(True)).select(*cols).unionByName(done.select(*cols))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives into the shared folder, read them back, resolve the revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm", "warc")
    write_archives(pages, path, min_bytes)
    return resolve_revisits(read_archives(spark, path, payloads=False))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hx
           FROM pages),
b AS (SELECT page_id, payload_bytes,
             array_to_string(list_transform(string_split(hx, ''),
                 lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111',
                        4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes,
             array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
                   + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
                   + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest FROM b),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
