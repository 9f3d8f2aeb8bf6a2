"""WARC archives: writing, normalising whole-file gzip streams, reading back (operator 2).

``write_archives`` makes one file a partition, compressed as a single stream.
``normalise`` inflates such a stream once from front to back, rewrites every record
as a gzip member of its own and writes a sidecar index with the offset and length
of each member, so that ``read_archives`` can open any record alone.

Files go to the shared folder under names that no other attempt uses; only the
paths that a finished task returns are read, so a lost executor leaves at most
files that nothing refers to.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize, shared_dir

LEVEL = 4
LEAST_REVISIT = 100
END = b"\r\n\r\n"


def payload(html):
    return F.coalesce(F.encode(html, "utf-8"), F.lit(b""))


def with_revisits(pages: DataFrame, *, most_broadcast: int = 200_000) -> DataFrame:
    """Add digest, n_bytes, refers_to: the smallest page_id of equal payloads, where that is another row.

    Payloads under 100 bytes refer to nothing. The groups of two or more are counted;
    up to ``most_broadcast`` of them (some 16 MB) go to every task, more are joined
    by shuffling, where Spark splits hot digests.
    """
    t = pages.withColumn("payload", payload(F.col("html")))
    t = t.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    groups = t.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.filter("n > 1 and first is not null").select("digest", "first"), "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= most_broadcast else groups
    t = t.join(groups, "digest", "left")
    return t.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record_id(page_id: int | None, digest: str) -> str:
    """The same for a page and payload in every run."""
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h[:16], version=5)}>"


def _record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record, an HTTP response: with its payload, or, a revisit, with the head alone."""
    revisit = row["refers_to"] is not None
    uri = quote(row["url"] or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}".encode() + END + (b"" if revisit else row["payload"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['digest'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http;msgtype=response",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}", f"X-Refers-To-Page: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + block + END


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names of S3 are read as s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_archives(records: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write each partition as one archive, a single gzip stream; returns (path, n_records).

    ``date`` is every record's WARC-Date: pages do not say when they were fetched.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/raw", recursive=True)
        name, n = f"raw/{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=LEVEL) as z:
            for batch in _chain(first, batches):
                for k in range(batch.num_rows):
                    z.write(_record({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}, date))
                    n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    columns = ["page_id", "url", "payload", "digest", "n_bytes", "refers_to"]
    return records.select(*columns).mapInArrow(write, "path string, n_records long")


def _chain(first, rest):
    yield first
    yield from rest


def _records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, whole record) of each record of an inflated stream, one at a time."""
    while version := stream.readline():
        head, fields = [version], {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        body = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != END:
            raise ValueError("a record does not end where its Content-Length says")
        yield fields, b"".join(head) + b"\r\n" + body + END


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with one gzip member a record; returns (path, index, n_records).

    Each source stream is inflated once. The index has a line for each member:
    offset, length, type, page id (tab-separated).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/members", recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source_fs, source = filesystem(path)
                name, at, lines = f"members/{uuid.uuid4().hex}.warc.gz", 0, []
                with source_fs.open_input_stream(source, compression=None) as f, gzip.GzipFile(fileobj=f) as z, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for fields, record in _records(z):
                        member = gzip.compress(record, LEVEL, mtime=0)
                        out.write(member)
                        lines.append(f"{at}\t{len(member)}\t{fields['WARC-Type']}\t{fields.get('X-Page-ID', '')}\n")
                        at += len(member)
                with fs.open_output_stream(f"{base}/{name}.idx") as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"], "n_records": [len(lines)]})

    return archives.select("path").mapInArrow(run, "path string, index string, n_records long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each opened at its index entry.

    A response's digest and length are taken from the payload read, a revisit's
    from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                fs, p = filesystem(path)
                with fs.open_input_stream(filesystem(index)[1]) as f:
                    entries = [line.split("\t") for line in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(p) as f:
                    for offset, length, *_ in entries:
                        f.seek(int(offset))
                        record = zlib.decompress(f.read(int(length)), 31)
                        head, _, rest = record.partition(END)
                        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
                        http, _, body = rest[: int(fields["Content-Length"])].partition(END)
                        revisit = fields["WARC-Type"] == "revisit"
                        rows.append({
                            "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
                            "payload_bytes": int(http.rpartition(b" ")[2]) if revisit else len(body),
                            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest(),
                            "record_type": fields["WARC-Type"],
                            "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None,
                            "url": fields["WARC-Target-URI"],
                        })
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "index").mapInArrow(run, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back ``pages`` (page_id, url, html): one row a page.

    Null html is an empty payload, a null url an empty URI; a payload of any length is one record. Rows without page_id
    revisit the smallest id of their payload, and are responses where no row has one;
    rows that repeat the smallest id are responses too. An empty table gives no rows;
    further columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    done = materialize(normalise(write_archives(with_revisits(pages), folder), folder), "warc-index")
    return read_archives(done.repartition(max(1, done.count())))
