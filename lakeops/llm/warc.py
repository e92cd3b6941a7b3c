"""WARC archives with revisit resolution.

Headers alone (key, payload digest, payload length) are shuffled by digest. Of records with equal payloads of at least
`least` bytes the one with the largest key is written as a response, the others as revisits that refer to it; smaller
payloads are all responses. Archives are written through Spark's text writer, whose line separator is the blank line
that ends a WARC record, so they can lie in any store that Spark reaches; each is a gzip file of bounded size, one member
without a warcinfo record. A record's id is a UUID made from its key and payload digest; the key itself is a header of
its own. Reading parses the records by their Content-Length, once, and joins revisits to the responses they refer to.

Edge cases: a null payload counts as empty; null and repeated keys each give a record of their own (a
group without any key has nothing to refer to, so all its records are responses); line ends in a URL
are percent-encoded; an empty table gives no archive and an empty result; other columns are dropped.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm.common import written

#: Parts of the format.
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"

#: Headers of this library: the key of a record, and of the one it refers to.
KEY, KEY_REFERRED_TO = "X-Lakeops-Key", "X-Lakeops-Refers-To-Key"

#: Payload bytes of one archive, about: what a reading task holds.
ARCHIVE_BYTES = 16 << 20
#: Date written where the input has none.
UNDATED = "1970-01-01T00:00:00Z"


def headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, url, body, bytes, digest (hex SHA-1 of the whole payload)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    address = F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return pages.select(F.col(key).cast("long").alias("key"), address.alias("url"), body.alias("body")).withColumns({"bytes": F.octet_length("body").cast("long"), "digest": F.sha1("body")})


def decided(heads: DataFrame, least: int) -> DataFrame:
    """Adds refers_to: null for a response, else the key of the response with the same payload. Only headers take part in the shuffle by digest."""
    small = heads.select("key", "url", "digest", "bytes")
    groups = small.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("key").alias("original"), F.max_by("url", "key").alias("original_url"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("original").isNotNull())
    joined = small.join(groups.select("digest", "bytes", "original", "original_url"), ["digest", "bytes"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    return joined.select("key", "url", "digest", "bytes", *(F.when(revisit, F.col(a)).alias(b) for a, b in (("original", "refers_to"), ("original_url", "refers_to_url"))))


def record_id(key: Column, digest: Column) -> Column:
    """A UUID made from a key and the digest of its payload."""
    h = F.md5(F.concat_ws(" ", F.coalesce(key.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def record(key: Column, url: Column, digest: Column, refers_to: Column, refers_to_url: Column, body: Column) -> Column:
    """Text of one record without its end."""
    revisit = refers_to.isNotNull()
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), body))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(key, digest)),
        F.lit(f"WARC-Date: {UNDATED}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit(f"{KEY}: "), F.coalesce(key.cast("string"), F.lit("none"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to, digest))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), refers_to_url)),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {UNDATED}")),
        F.when(revisit, F.concat(F.lit(f"{KEY_REFERRED_TO}: "), refers_to.cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END), block)


def write(pages: DataFrame, path: str, least: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes deduplicated archives with fresh headers to the folder `path`.

    Decisions travel back to the payloads by key alone. A repeated key that is the original of its payload is written
    as a response each time.
    """
    heads = headers(pages, key, url, payload)
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    found = decided(heads, least).where(F.col("refers_to").isNotNull()).groupBy(F.col("key").alias("k"), F.col("digest").alias("d")).agg(F.max("refers_to").alias("refers_to"), F.max("refers_to_url").alias("refers_to_url"))
    revisits = written(found, "revisits")  # of known size: joined to the payloads by broadcast below the session's bound only
    joined = heads.join(revisits, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    text = joined.select(F.xxhash64("key", "url").alias("at"), record(F.col("key"), F.col("url"), F.col("digest"), F.col("refers_to"), F.col("refers_to_url"), F.col("body")).alias("value"))
    files = max(1, -(-total // ARCHIVE_BYTES))
    text.repartition(files, "at").select("value").write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split(CRLF)
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + len(RECORD_END)


def _key(number: str | None) -> int | None:
    return int(number) if (number or "").lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: key, url, record_type, refers_to, payload_digest (hex, as the header states it), checked (the block's own digest agrees; null for revisits), bytes of the block's payload, payload (null for revisits)."""
    schema = "key long, url string, record_type string, refers_to long, payload_digest string, checked boolean, bytes long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for fields, block in parsed(gzip.decompress(archive.as_py())):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
                    checked = None if revisit else hashlib.sha1(payload).hexdigest() == digest
                    rows.append((_key(fields[KEY]), fields["WARC-Target-URI"], fields["WARC-Type"], _key(fields.get(KEY_REFERRED_TO)), digest, checked, None if revisit else len(payload), payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Headers of the records (all but the payload), each revisit with the payload size of the response it refers to. Archives are parsed once: the headers are written."""
    records = written(records.drop("payload"), "headers")
    first = records.where(F.col("record_type") == "response").groupBy(F.col("key").alias("original"), F.col("payload_digest").alias("_digest")).agg(F.max("bytes").alias("_bytes"))
    wanted = records.where(F.col("record_type") == "revisit").select("refers_to", "payload_digest").distinct()
    first = first.join(wanted, (F.col("original") == wanted["refers_to"]) & (F.col("_digest") == wanted["payload_digest"]), "left_semi")
    joined = records.join(first, (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.withColumn("bytes", F.coalesce("bytes", "_bytes")).drop("original", "_digest", "_bytes")
