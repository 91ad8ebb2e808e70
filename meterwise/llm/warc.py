"""Web pages in WARC files with an index: written once, read back by coalesced byte ranges.

``write`` puts every page into gzipped WARC records (one gzip member each) in files of the
shared folder, and returns the index: file, offset, length, URL and digest per record. Each
task writes its own new files; the index is committed by Spark, so files of lost or repeated
tasks are in no index and are never read. ``read`` takes index rows (all, or a selection),
deals them out by file and stretch of the file, sorts them by offset, joins ranges with small
gaps into one read and parses the records.

Records with equal payloads of at least ``MIN_REVISIT`` bytes: that with the smallest page_id
holds the payload (response), the others only refer to it (revisit, with the digest and length
of the full payload). A payload that many pages share is one row per task before the shuffle
that finds the smallest id; the join back is split by the skew join.

Edge cases: a null html is an empty payload; a null url is written as urn:page:<id>, line
breaks in a url as %0D and %0A. Repeated rows with the smallest id are all responses. A null
page_id is written without the header, reads back as null, and refers to the smallest id of
its payload; if none has an id, all are responses. Empty tables write no record. Other columns
are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import new_folder, written

MIN_REVISIT = 100
#: A new file after so many bytes; records read together; the largest gap read over.
FILE_BYTES = 256 << 20
STRETCH = 8 << 20
GAP = 64 << 10
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def _record(page_id: int | None, url: str | None, payload: str, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record, gzipped."""
    revisit = refers_to is not None
    target = (url if url is not None else f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Url: 1")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload.encode()
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    data = _record(page_id, url, payload, digest, size, refers_to)
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), page_id, url, digest, size, "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["file", "offset", "length", "page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row (page_id, url, html); returns the index, itself a written table."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    known = rows.join(shared, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return written(known.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to")).mapInArrow(_writer(folder), INDEX), "warc-index")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of one gzipped record."""
    raw = zlib.decompress(data, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            spots = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            rows, k = [], 0
            while k < len(spots):
                # ranges of one file that follow each other closely are read at once
                file, start, length = spots[k]
                j, stop = k + 1, start + length
                while j < len(spots) and spots[j][0] == file and spots[j][1] - stop <= GAP and spots[j][1] + spots[j][2] - start <= STRETCH:
                    stop = max(stop, spots[j][1] + spots[j][2])
                    j += 1
                if name != file:
                    if opened is not None:
                        opened.close()
                    fs, path = pafs.FileSystem.from_uri(file)
                    opened, name = fs.open_input_file(path), file
                data = opened.read_at(stop - start, start)
                for _, at, n in spots[k:j]:
                    head, payload = parse(data[at - start : at - start + n])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{file} at {at}: the payload does not match its digest")
                    number = lambda x, h=head: int(h[x]) if x in h else None
                    rows.append((number("X-Page-Id"), None if "X-No-Url" in head else head["WARC-Target-URI"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page"), payload.decode() if kind == "response" else None))
                k = j
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * with_payload)
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        if opened is not None:
            opened.close()

    return run


def read(index: DataFrame, *, payload: bool = True) -> DataFrame:
    """The records of the index rows given: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, if asked for, payload (null for a revisit)."""
    size = index.agg(F.sum("length")).first()[0] or 0
    spots = index.select("file", "offset", "length").repartition(max(1, -(-size // STRETCH)), "file", F.floor(F.col("offset") / F.lit(STRETCH))).sortWithinPartitions("file", "offset")
    return spots.mapInArrow(_reader(payload), RECORD + (", payload string" if payload else ""))
