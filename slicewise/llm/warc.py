"""WARC records in seekable Zstandard bundles: writing, an index into them, and reading back.

Records are grouped into frames of about ``bundles.FRAME_BYTES``, each compressed on its own; a
bundle is the frames and, as its footer, a seek table in a skippable frame (sizes of all
frames), so that any frame can be found and read alone. The index maps every record
identifier to its bundle, its frame and its offset in the frame's plain bytes.

Of payloads of at least ``REVISIT_FROM`` bytes that are equal, the page with the largest
id is stored as response, the others as revisits without payload.

Tasks write bundles under names of their attempt, and hand on index rows for finished
bundles only: a bundle counts when the written index names it, and what a lost or
repeated attempt leaves behind is never read. Bundles go to the folder by pyarrow's file
systems, so any shared store that those know will do.

Defined results: a null payload is the empty one; equal rows with the largest id of a
group are all responses; a null id counts as the smallest, and a group with null ids only
is all responses; a null url gives no target header; characters that would break a header
are percent-encoded; an empty table writes nothing; other columns are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.session import durable, fresh_path
from slicewise.sources.bundles import Bundle, read_frame, seek_table

REVISIT_FROM = 1000
BUNDLE_BYTES = 64 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record; a revisit holds the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records in plain bytes from ``at`` on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(headers["Content-Length"])
        yield at, headers, data[end + 4:stop]
        at = stop + 4


def opened(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    return fs.FileSystem.from_uri(path)


def decided(pages: DataFrame) -> DataFrame:
    """Adds digest, size, refers_to and revisit to (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("bigint"))
    large = rows.filter(F.col("size") >= REVISIT_FROM).select("digest", "page_id")
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    older = F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return rows.join(firsts, "digest", "left").withColumn("revisit", older)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles of (page_id, url, html) and returns their index, which is written too.

    Index: path, record_id, frame, frame_at, record_at, record_bytes.
    """
    rows = decided(pages).select("page_id", "url", "html", "size", "digest", "refers_to", "revisit")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        bundle, path, found, n = None, "", [], 0

        def close() -> pa.RecordBatch:
            bundle.close()
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["path", "record_id", "frame", "frame_at", "record_at", "record_bytes"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for page_id, url, html, size, digest, refers_to, revisit in zip(*columns, strict=True):
                if bundle is None:
                    path, n, found = f"{folder}/{name}-{n}.warc.zst", n + 1, []
                    bundle = Bundle(store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None))
                data = record(page_id, url, html, size, digest, refers_to, revisit)
                found.append((path, record_id(page_id), *bundle.add(data), len(data)))
                if bundle.at >= BUNDLE_BYTES:
                    yield close()
                    bundle = None
        if bundle is not None:
            yield close()

    schema = "path string, record_id string, frame bigint, frame_at bigint, record_at bigint, record_bytes bigint"
    return durable(rows.mapInArrow(step, schema), "warc-index")


def _told(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), the digest checked."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    page, kind = page_of(headers["WARC-Record-ID"]), headers["WARC-Type"]
    if kind == "revisit":
        return page, size, digest, kind, page_of(headers["WARC-Refers-To"])
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload of page {page}")
    return page, size, digest, kind, None


def read(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the bundles in an index."""
    bundles = index.select("path").distinct()
    n = bundles.count()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = opened(path)
                size = store.get_file_info(inner).size
                with store.open_input_file(inner) as source:
                    for frame in seek_table(source, size):
                        rows = [_told(headers, block) for _, headers, block in parse(read_frame(source, *frame))]
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # twice as many tasks as bundles, so that few meet; the number is one count, not rows
    spread = bundles.repartition(min(max(2 * n, 1), 20_000), "path")
    return spread.mapInArrow(step, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_id, record) of the wanted (record_id): only their frames are read and unpacked."""
    wanted = index.join(ids.select("record_id").distinct(), "record_id").select("path", "frame", "frame_at", "record_at", "record_id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            data, last = b"", None
            out = []
            for r in rows:
                if (r["path"], r["frame"]) != last:
                    last = r["path"], r["frame"]
                    store, inner = opened(r["path"])
                    with store.open_input_file(inner) as source:
                        data = read_frame(source, *seek_table(source, store.get_file_info(inner).size)[r["frame"]])
                end = next((at for at, _, _ in _after(data, r["record_at"])), len(data))
                out.append(data[r["record_at"]:end])
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(out, pa.binary())], ["record_id", "record"])

    return wanted.repartition("path").sortWithinPartitions("path", "frame").mapInArrow(step, "record_id string, record binary")


def _after(data: bytes, at: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    records = parse(data, at)
    next(records)
    return records


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back."""
    return read(write(pages, fresh_path(pages.sparkSession, "warc")))
