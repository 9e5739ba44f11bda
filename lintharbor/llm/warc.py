"""WARC archives with an index written first and coalesced byte-range reads.

``write_archives`` deals the pages out into per-record gzip WARC files and returns the index (file, offset, length, url,
digest per record); ``read_records`` sorts selected index rows by file and offset, merges neighbouring ranges into bounded
reads and parses the records. Records whose payload occurs more than once are kept once: the others become revisits.

Cases: a null payload is empty; null url or page_id leave their header out, and line breaks in a url are percent-encoded; repeated rows (same page_id and payload) are
written once each and are responses alike where their page_id is the largest; an empty table gives an empty index;
further columns are ignored. Payload equality is that of SHA-256."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, join_unique, materialize, partitions, work_dir

INDEX = "page_id long, warc_file string, warc_offset long, warc_length long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
#: Bytes: a file is closed beyond the first; ranges no further apart than the second are read together, up to the third.
FILE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 4 << 20
#: Records of a batch of results.
ROWS = 4096
#: Hadoop's names of stores that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a folder that Hadoop names."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """One WARC/1.1 record and its payload digest. A revisit holds the HTTP header only, with the full payload's length."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), payload None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    number = lambda k: int(fields[k][len("<urn:page:") : -1]) if k in fields else None
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, kind, number("WARC-Refers-To"), payload if kind == "response" else None


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        part, out, name, at, n = TaskContext.get().partitionId(), None, "", 0, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, keep in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "keep")), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    # a name of its own for each attempt: the index lists only what the attempt that counted wrote
                    name, at, n = f"part-{part:05d}-{n:03d}-{uuid.uuid4().hex}.warc.gz", 0, n + 1
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                revisit = keep is not None and keep != page_id
                raw, digest = record_bytes(page_id, url, payload.encode("utf-8", "surrogatepass"), keep if revisit else None, revisit)
                deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = deflate.compress(raw) + deflate.flush()
                out.write(member)
                rows.append((page_id, name, at, len(member), url, digest, "revisit" if revisit else "response"))
                at += len(member)
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder``; return the written index.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("sha"))
    copies = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    marked = join_unique(keyed, materialize(copies, f"{folder}/copies"), "sha", "n", F.col("page_id"))
    index = marked.select("page_id", "url", "payload", "keep").mapInArrow(_writer(f"{folder}/warc", file_bytes), INDEX)
    return materialize(index, f"{folder}/index")


def _reader(folder: str, gap: int, most: int, with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        name, file, run = None, None, []

        def fetch() -> Iterator[pa.RecordBatch]:
            start = run[0][0]
            file.seek(start)
            data = file.read(run[-1][0] + run[-1][1] - start)
            rows, size = [], 0
            for i, (o, n) in enumerate(run):  # one record is inflated at a time, and results are bounded by what was inflated
                raw = zlib.decompress(data[o - start : o - start + n], 31)
                r = parse_record(raw)
                rows.append((*r[:6], r[6].decode("utf-8", "surrogatepass") if with_payload and r[6] is not None else None))
                size += len(raw) if with_payload else 0
                if size >= most or i == len(run) - 1 or len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                    rows, size = [], 0

        for batch in batches:
            for of, offset, length in zip(*(batch.column(c).to_pylist() for c in ("warc_file", "warc_offset", "warc_length")), strict=True):
                if run and (of != name or offset > run[-1][0] + run[-1][1] + gap or offset + length - run[0][0] > most):
                    yield from fetch()
                    run = []
                if of != name:
                    if file is not None:
                        file.close()
                    name, file = of, store.open_input_file(f"{base}/{of}")
                run.append((offset, length))
        if run:
            yield from fetch()
        if file is not None:
            file.close()

    return read


def read_records(index: DataFrame, folder: str, where: Column | None = None, with_payload: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records of the index rows that ``where`` selects, read in merged byte ranges sorted by file and offset."""
    chosen = (index if where is None else index.filter(where)).select("warc_file", "warc_offset", "warc_length")
    n = partitions(index.sparkSession)
    ranged = chosen.repartitionByRange(n, "warc_file", "warc_offset").sortWithinPartitions("warc_file", "warc_offset")
    return ranged.mapInArrow(_reader(f"{folder}/warc", gap, most, with_payload), RECORD)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages``, read them back whole and return what the records say of each page."""
    folder = work_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder, min_bytes)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
