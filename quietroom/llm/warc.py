"""WARC archives: write page captures as records, read them back as transactions.

A capture is three records: the response (or a revisit of an equal payload), the request and
metadata, the last two tied to the first by WARC-Concurrent-To. Records are built by column
expressions and written by Spark's text writer, whose line separator is the end of a record, so
any file system and the task commit protocol work as for other tables. Reading parses each archive
by Content-Length, joins the three kinds of record through their identifiers and gives one nested
row for each capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import query, shared_path, stored, table

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture
RECORDS_PER_FILE = 30_000


def sha1_base32(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32: 160 bits as four numbers of 40, eight letters each."""
    digest, letters = F.sha1(data), []
    for i in range(4):
        bits = F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long")
        for j in range(8):
            at = F.shiftright(bits, 35 - 5 * j).bitwiseAND(31).cast("int") + 1
            letters.append(F.substr(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def record_id(kind: str, page_id: Column, url: Column, payload_hash: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in (page_id, url, payload_hash)]
    digest = F.md5(F.concat_ws("\x01", F.lit(kind), *parts))
    groups = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def record(kind: Column | str, fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """The text of one record without its end; fields whose value is null are left out."""
    named = [("WARC-Type", kind), ("WARC-Date", DATE), *fields]
    lines = [
        F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value))
        for name, value in named
    ]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block))
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines, size), F.lit(END), block)


def one_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive ``page_id, url, html``, three records for each row, as gzipped files below ``path``.

    Of equal payloads of at least ``min_bytes`` bytes, the one with the largest ``page_id`` (then
    ``url``) is the response and the others revisit it; smaller payloads are all responses. A null
    page is an empty payload; null ids and urls are kept as such. Rows equal in all three columns
    give equal records. Further columns are not archived.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("hash", F.sha2(F.col("payload").cast("binary"), 256))
    last = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("hash")
        .agg(F.max(F.struct("page_id", "url")).alias("last"))
    )
    joined = rows.join(last, "hash", "left").withColumn(
        "revisit",
        F.col("last").isNotNull()
        & ~(
            F.col("page_id").eqNullSafe(F.col("last.page_id"))
            & F.col("url").eqNullSafe(F.col("last.url"))
        ),
    )
    own = {
        kind: record_id(kind, F.col("page_id"), F.col("url"), F.col("hash"))
        for kind in ("response", "request", "metadata")
    }
    target = one_line(F.col("url"))
    digest = F.concat(F.lit("sha1:"), sha1_base32(F.col("payload").cast("binary")))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload"),
        F.lit(END),
    )
    origin = record_id("response", F.col("last.page_id"), F.col("last.url"), F.col("hash"))
    again = F.col("revisit")
    response = record(
        F.when(again, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", own["response"]),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(again, PROFILE)),
            ("WARC-Refers-To", F.when(again, origin)),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(again, head).otherwise(F.concat(head, "payload")),
    )
    address = F.coalesce(target, F.lit("/"))
    request = record(
        "request",
        [
            ("WARC-Record-ID", own["request"]),
            ("WARC-Target-URI", target),
            ("WARC-Concurrent-To", own["response"]),
            ("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(F.lit("GET "), address, F.lit(" HTTP/1.1" + END)),
    )
    metadata = record(
        "metadata",
        [
            ("WARC-Record-ID", own["metadata"]),
            ("WARC-Target-URI", target),
            ("WARC-Concurrent-To", own["response"]),
            ("Content-Type", "application/json"),
        ],
        F.to_json(F.struct("page_id", "url")),
    )
    joined.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option(
        "compression", "gzip"
    ).option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(stream):
    """(fields, block) of each record of a decompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != VERSION.encode():
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a record is cut short")
        yield fields, block


RECORD = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "payload_bytes bigint, payload_digest string, info string"
)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records below ``path``, with their payloads if asked for.

    Payload size and digest of a response are taken from the payload and compared with its
    headers; those of a revisit come from the headers. A damaged archive raises an error.
    """
    schema = RECORD + (", payload binary" if payload else "")
    kinds = [pa.int64() if " bigint" in c else pa.string() for c in RECORD.split(", ")]
    kinds += [pa.binary()] * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def row(fields: dict[str, str], block: bytes) -> tuple:
        size = digest = info = body = None
        if fields["warc-type"] in ("response", "revisit"):
            head, _, body = block.partition(END.encode())
            told = [h for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:")]
            size = int(told[0].partition(b":")[2])
            digest = fields["warc-payload-digest"].partition(":")[2]
            if fields["warc-type"] == "response":
                real = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if (len(body), real) != (size, digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match")
        elif fields["warc-type"] == "metadata":
            info = block.decode()
        known = (
            fields["warc-type"],
            fields["warc-record-id"],
            fields.get("warc-concurrent-to"),
            fields.get("warc-refers-to"),
            fields.get("warc-target-uri"),
            size,
            digest,
            info,
        )
        return (*known, body) if payload else known

    def emit(rows):
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for fields, block in parse_records(stream):
                        rows.append(row(fields, block))
                        held += len(block) if payload else 200
                        if held > 4_000_000:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``response``, ``request``, ``metadata`` structs.

    ``response`` is the response or revisit record, with ``payload`` if the records carry it, and
    ``origin`` the metadata of the response a revisit refers to. Records that are equal, from
    repeated rows, are joined once and then repeated as often as the response occurred. A capture
    without request or metadata has nulls there; those without a response are left out.
    """
    slim = ["record_id", "target_uri"]
    body = [F.first("payload").alias("payload")] if "payload" in records.columns else []
    seen = records.where("kind IN ('response', 'revisit')")
    keys = ["kind", *slim, "refers_to", "payload_bytes", "payload_digest"]
    responses = seen.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("copies"), *body)
    fields = [*keys, *(["payload"] if body else [])]
    responses = responses.select(
        F.col("record_id").alias("id"), F.struct(*fields).alias("response"), "copies"
    )

    def tied(kind: str, *more: str) -> DataFrame:
        own = records.where(F.col("kind") == kind).select("concurrent_to", *slim, *more).distinct()
        return own.select(F.col("concurrent_to").alias("id"), F.struct(*slim, *more).alias(kind))

    metadata = tied("metadata", "info")
    origin = metadata.select(
        F.col("id").alias("origin_id"), F.col("metadata.info").alias("origin")
    )
    return (
        responses.join(tied("request"), "id", "left")
        .join(metadata, "id", "left")
        .join(origin, F.col("response.refers_to") == F.col("origin_id"), "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("response", "request", "metadata", "origin")
    )


_LETTERS = " || ".join(
    f"substr('{BASE32}', (((('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT >> {35 - 5 * j}) & 31)"
    " + 1)::INTEGER, 1)"
    for i in range(4)
    for j in range(8)
)

ORACLE = f"""
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
    SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
           {_LETTERS} AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM q
"""


@query("op9_warc", ORACLE)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, folder, "pages"), path)
    records = stored(read_records(spark, path, payload=False), "warc-records")
    captures = assemble(records)

    def page(info: str) -> Column:
        return F.get_json_object(info, "$.page_id").cast("long")

    return captures.select(
        page("metadata.info").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.kind").alias("record_type"),
        page("origin").alias("refers_to"),
    )
