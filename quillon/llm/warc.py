"""WARC archives with revisit records: headers are resolved by payload digest, then fresh records are written.

Every page becomes one record. Its payload is its html in UTF-8, its digest the bare upper-case base32 SHA-1 of the
whole payload. Only headers (page_id, length, digest) are shuffled: of the pages with equal payloads of at least
min_bytes bytes, that with the least page_id becomes the response, and the others become revisit records that refer to
it, without a payload; smaller payloads are all responses. The originals that something revisits go back to the pages by
broadcast, if they are at most BROADCAST_ORIGINALS; else each page's verdict is joined to it by page_id and digest, a
key that no two distinct pages share, so copies of one payload, however many, are no hot key.

Records are written by Spark's text writer, so each task's file is committed once and in whole, to any file system:
a record's closing CRLF CRLF is the writer's line separator. Files are gzip-compressed as a whole and hold about
FILE_BYTES of records. read_archives() takes the files as bytes and parses records by their Content-Length,
decompressing step by step; length and digest of a response are computed anew from its payload, and one that its
headers belie is an error.

Defined results: a null html is an empty payload; a null page_id comes after all others and is written as an empty
header value, read back as null; repeated rows of the least page_id are all responses (they are one page); a null
url is an empty header value and read back as null; an empty table gives empty archives. Other columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.scratch import cut, new_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
STEP = 1 << 20
#: Bytes of records in a file, and records at most.
FILE_BYTES, FILE_RECORDS = 64 << 20, 20_000
BROADCAST_ORIGINALS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Five hexadecimal digits are 20 bits, which are four letters; a SHA-1 has eight such groups.

    The digest and each group's bits are bound by a lambda, so that they are computed once."""
    bits = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(h, 5 * g + 1, F.lit(5)), 16, 10).cast("int"))
    four = lambda b: F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(b, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])
    return F.get(F.transform(F.array(F.sha1(payload)), lambda h: F.array_join(F.transform(bits(h), four), "")), F.lit(0))


def resolve(pages: DataFrame, min_bytes: int = 0, broadcast_originals: int = BROADCAST_ORIGINALS) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.encode("html", "utf-8")))
    headers = cut(rows.select("page_id", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= min_bytes), "headers")
    first = headers.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null")
    first = cut(first.drop("_n"), "originals")
    if first.count() <= broadcast_originals:
        joined = rows.join(F.broadcast(first), (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    else:
        revisits = headers.join(first, F.col("payload_digest") == F.col("_digest")).where(~F.col("page_id").eqNullSafe(F.col("_first")))
        revisits = cut(revisits.select(F.col("page_id").alias("_id"), "_digest", "_first").distinct(), "revisits")
        joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        *rows.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to")
    )


def _safe(value: Column) -> Column:
    """Header values hold no line breaks; those and percent signs become percent escapes."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for c, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def record_id(page_id: Column, digest: Column) -> Column:
    """<urn:uuid:...> from a digest of the page's id and payload."""
    plain = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def record(date: str) -> Column:
    """One WARC record of a resolved page, without the CRLF CRLF that closes it."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _safe(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Page-ID", _safe(F.col("page_id"))), line("X-Has-URI", F.col("url").isNotNull().cast("string")), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))), line("X-Refers-To-Page", _safe(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Fresh archives with revisits under path; a file holds about file_bytes of records of one task."""
    mean = pages.select(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0.0
    records = max(1, min(FILE_RECORDS, int(file_bytes / (mean + 500))))
    rows = resolve(pages, min_bytes).select(record(date).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive file, given in pieces; only one record is held at a time."""
    buffer = bytearray()
    done = False

    def more() -> bool:
        nonlocal done
        piece = next(chunks, None)
        done = piece is None
        buffer.extend(piece or b"")
        return not done

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if buffer.strip():
                raise ValueError("a record breaks off")
            return
        version, *lines = bytes(buffer[:at]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines)
        length = int(headers["Content-Length"])
        del buffer[: at + 4]
        while len(buffer) < length + 4 and more():
            pass
        if buffer[length : length + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield headers, bytes(buffer[:length])
        del buffer[: length + 4]


def _inflate(content: bytes) -> Iterator[bytes]:
    z = zlib.decompressobj(31)
    view = memoryview(content)
    for at in range(0, len(view), STEP):
        rest: bytes = bytes(view[at : at + STEP])
        while rest:
            yield z.decompress(rest, 4 * STEP)
            rest = z.unconsumed_tail
            if z.eof and z.unused_data:
                rest, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def _rows(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for h, body in parse(_inflate(batch.column(0)[i].as_buffer().to_pybytes())):
                url = unquote(h["WARC-Target-URI"]) if h["X-Has-URI"] == "true" else None
                refers = unquote(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None
                length, digest, html = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                if h["WARC-Type"] == "response":
                    if (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) != (length, digest):
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} isn't what its headers say")
                    html = body.decode("utf-8") if payloads else None
                rows.append((unquote(h["X-Page-ID"]) or None, url, length, digest, h["WARC-Type"], refers, html))
                size += len(body) if payloads else 200
                if size > STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives under path; revisits have a null html, responses one if payloads is set."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    out = files.mapInArrow(lambda it: _rows(it, payloads), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read their records back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
