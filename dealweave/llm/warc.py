"""Web archives with revisit records.

Payload digests are shuffled without their payloads: an aggregation names, for each digest, the smallest page id that
holds it. Joined back, that page becomes the response record and every other page with the payload a revisit of it.
The archives are written by Spark's text writer, whose row separator is the blank line that ends a WARC record, so each
part file is an archive, written with Spark's commit protocol on any file system. Reading takes archives as binary
files and walks records by their Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm.common import SLICE_BYTES, stored

END = "\r\n\r\n"
#: Payloads below this size are never replaced by a revisit record.
SMALLEST = 100


def resolved(pages: DataFrame, page_id: str = "page_id", payload: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """Add ``payload_digest`` (bare SHA-256), ``payload_bytes``, ``record_type`` and ``refers_to`` to every row.

    Among rows with equal payloads of at least ``smallest`` bytes the smallest page id is the response, the others
    revisit it; rows that repeat that id are responses too. Null payloads count as empty. A null id is larger than any
    other, and where all ids of a payload are null all are responses. Input columns with these names are replaced.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    known = ["payload_digest", "payload_bytes", "record_type", "refers_to"]
    rows = pages.drop(*known).withColumns({"payload_digest": F.sha2(body, 256), "payload_bytes": F.octet_length(body).cast("bigint")})
    headers = rows.where(F.col("payload_bytes") >= smallest).select("payload_digest", F.col(page_id).alias("id"))
    first = headers.groupBy("payload_digest").agg(F.min("id").alias("__first"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(first.drop("n"), "payload_digest", "left")
    revisit = F.col("__first").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("__first"))
    return met.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("__first")),
    }).select(*pages.drop(*known).columns, *known)


def _line(name: str, value: Column) -> Column:
    """A header line; left out when the value is null. Line breaks inside a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    """Name of the record that holds a page's payload, the same wherever it is derived."""
    text = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(date: str) -> Column:
    """Text of a record without the blank line that ends it, with fresh headers."""
    response = F.col("record_type") == "response"
    fresh = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    own = F.when(response & F.col("page_id").isNotNull(), _record_id(F.col("page_id"), F.col("payload_digest"))).otherwise(fresh)
    body = F.when(response, F.coalesce(F.col("payload").cast("string"), F.lit(""))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(~response, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(~response, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("X-Page-ID", F.col("page_id")), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body)), F.lit("\r\n"))
    return F.concat(head, body)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "1970-01-01T00:00:00Z", smallest: int = SMALLEST, compression: str = "gzip") -> None:
    """Write one record per row, duplicates as revisits, into archives below ``folder``."""
    rows = resolved(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload")),
                    "page_id", "payload", smallest)
    records = rows.select(_record(date).alias("value"))
    records.write.option("lineSep", END).option("compression", compression).text(folder)


def _records(content: bytes):
    """Header fields and body of each record of an archive, one at a time."""
    with io.BytesIO(content) as packed, gzip.GzipFile(fileobj=packed) if content[:2] == b"\x1f\x8b" else packed as file:
        while file.readline():
            fields = {}
            while (line := file.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                fields[name.decode()] = value.decode()
            body = file.read(int(fields["Content-Length"]))
            if len(body) < int(fields["Content-Length"]) or file.read(4) != END.encode():
                raise ValueError("an archive record does not end where its length says")
            yield fields, body


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: ``page_id, url, record_type, record_id, refers_to_record, payload_digest, payload``.

    ``payload`` is null for revisits. The digest of a response's body has to agree with its header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, body in _records(content.as_py()):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = fields["WARC-Type"] == "response"
                    if response and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError("a payload does not have the digest of its record")
                    rows.append((
                        int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, fields.get("WARC-Target-URI"),
                        fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), digest,
                        body.decode() if response else None))
                    held += len(body)
                    if held > SLICE_BYTES or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, _ROW)


_ROW = ("page_id bigint, url string, record_type string, record_id string, refers_to_record string, "
        "payload_digest string, payload string")
_TYPES = [pa.int64(), *[pa.string()] * 6]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _ROW.split(", ")])


def read_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder without payloads: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to``.

    Revisit records are joined with the response they refer to, which gives its page id and the payload's length.
    """
    records = read_archives(spark, folder).withColumn("size", F.octet_length("payload").cast("bigint")).drop("payload")
    records = stored(records, folder + "-headers")
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("size").alias("full"),
    ).dropDuplicates(["refers_to_record"])
    met = records.join(responses, "refers_to_record", "left")
    return met.select("page_id", "url", "record_type", F.coalesce("size", "full").alias("payload_bytes"),
                      "payload_digest", "refers_to")
