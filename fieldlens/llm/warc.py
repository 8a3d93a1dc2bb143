"""WARC archives: an index first, then coalesced byte-range reads of the selected records.

Writing: each task appends records, one gzip member each, to archives of its own in the shared folder, and returns the index: file, offset, length,
url and digest of each record. The index is settled, so that it names the files of the tasks that succeeded; a file of a task that was
run again is never named. Reading: selected index rows are sorted by file and offset, ranges that lie close together are read in one go,
and records are cut out of them.

Of records with equal payloads of at least ``REVISIT`` bytes that with the largest page_id is a response and the others
revisit it; rows that repeat that page_id are responses as well.

Defined cases: null html is an empty payload, null url is left out of the record; a null page_id is smaller than any other; rows that repeat a
page are records each; other columns are ignored; an empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_folder, table

#: Payloads of fewer bytes are always responses (the contract's).
REVISIT = 1000
#: Bytes of an archive after which a new one begins; the largest gap read over, and the largest range read in one go.
ARCHIVE, GAP, RANGE = 256 << 20, 64 << 10, 8 << 20

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": page_id,
        "WARC-Payload-Length": size,
        "WARC-Refers-To-Page": refers_to,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": 0 if revisit else size,
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, block[: int(fields["Content-Length"])]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives below ``folder`` and returns their index."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Only payloads that occur twice come back; they are few next to the pages, and the pages' side of a hot digest is split.
    again = (
        rows.where(F.octet_length("html") >= REVISIT)
        .groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    joined = rows.join(again, "digest", "left")

    def run(batches):
        where, base = _place(folder)
        out, at, name = None, 0, None
        for batch in batches:
            index = []
            for page_id, url, text, digest, last in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "last")), strict=True):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                page_id, url, digest, last = page_id.as_py(), url.as_py(), digest.as_py(), last.as_py()
                payload = text.as_py().encode()
                refers_to = last if last is not None and last != page_id else None
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(_record(page_id, url, payload, digest, len(payload), refers_to)) + packer.flush()
                out.write(member)
                index.append((page_id, url, name, at, len(member), digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            yield _batch(index, INDEX_ARROW)
        if out is not None:
            out.close()

    _place(folder)[0].create_dir(_place(folder)[1], recursive=True)
    return settled(joined.select("page_id", "url", "html", "digest", "last").mapInArrow(run, INDEX))


INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ranges(batches):
    """Runs of index rows of one file whose ranges lie close together."""
    run: list[tuple[str, int, int]] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + GAP or row[1] + row[2] - run[0][1] > RANGE):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows given: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Each response's payload is checked against its digest and length.
    """
    laid = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        where, base = _place(folder)
        for ranges in _ranges(batches):
            start = ranges[0][1]
            with where.open_input_file(f"{base}/{ranges[0][0]}") as file:
                data = file.read_at(ranges[-1][1] + ranges[-1][2] - start, start)
            rows = []
            for _, offset, length in ranges:
                fields, payload = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the payload at {offset} of {ranges[0][0]} is not what its header says")
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                rows.append((number("WARC-Page-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To-Page"), fields.get("WARC-Target-URI"), payload if payloads and fields["WARC-Type"] == "response" else None))
            yield _batch(rows, READ_ARROW)

    return laid.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write(table(spark, folder, "pages"), archives)
    return read(index, archives, payloads=False).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
l AS (SELECT d, max(page_id) AS last, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN c > 1 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN l USING (d)
"""
