"""WARC archives: a normaliser that turns a file-long gzip stream into one member per record, with an offset index beside it.

Crawlers that compress a whole archive as one stream leave files that can't be entered in the middle. `normalise`
inflates such a stream once, from front to back and CHUNK bytes at a time, writes each record as its own gzip member and lists
every member's offset and length in a sidecar (`.idx`, tab-separated), so that a reader can seek to any record.

The archives lie in a shared folder; each is written under a temporary name and renamed, so a task that runs again
replaces its own file. A record's payload is held in memory, an archive never is.

Defined results: a null html is an empty payload; a null page_id is read back as null, is the smallest of none and so
never a response that others refer to; pages that repeat with the smallest page_id of their payload are all responses;
a null url leaves out its header, and control characters in a url are percent-encoded. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, new_path, small

#: Payloads under so many bytes are stored with every page.
REVISIT_FROM = 100
CHUNK = 1 << 18
_HEAD = re.compile(rb"\r\n\r\n")


def _filesystem(folder: str):
    from pyarrow import fs

    if not re.match(r"[a-z0-9]+:", folder):
        folder = f"file://{folder}"
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))  # Hadoop's names of a scheme that Arrow knows


def _put(system, path: str, write) -> object:
    """Calls write(stream) on a temporary name, then renames it to path."""
    out = f"{path}.{id(write):x}.tmp"
    with system.open_output_stream(out, compression=None) as stream:
        found = write(stream)
    system.move(out, path)
    return found


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the whole payload's digest and size in its headers, and no block."""
    block = b"" if refers_to is not None else payload
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z"
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {
        k.strip().lower(): v.strip() for k, _,
        v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    }


def records(stream: BinaryIO) -> Iterator[bytes]:
    """The records of a gzip file, whether one stream or many members, inflated once and held one at a time."""
    unzip, raw, held, need = zlib.decompressobj(31), b"", bytearray(), None
    while True:
        if need is None and (end := held.find(b"\r\n\r\n")) >= 0:
            need = end + 4 + int(headers(bytes(held[:end])).get("content-length", 0)) + 4
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = None
            continue
        raw = raw or stream.read(CHUNK)
        if not raw:
            if rest := unzip.flush():
                held += rest
                continue
            if held.strip():
                raise ValueError("the archive ends inside a record")
            return
        held += unzip.decompress(raw, CHUNK)  # no more at once, however well it was compressed
        raw = unzip.unconsumed_tail
        if unzip.eof:
            raw, unzip = unzip.unused_data, zlib.decompressobj(31)


def normalise(source: BinaryIO, members: BinaryIO, level: int = 6) -> list[tuple[int, int]]:
    """Rewrites each record of source as a gzip member of its own; returns the members' offsets and lengths."""
    index, at = [], 0
    for item in records(source):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        data = packer.compress(item) + packer.flush()
        members.write(data)
        index.append((at, len(data)))
        at += len(data)
    return index


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to: of equal payloads of REVISIT_FROM bytes or more, all but the smallest page_id refer to it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    full = full.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = full.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("copies")
    )
    copied = materialize(groups.where("copies > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id"), "copies")
    return full.join(small(copied), "payload_digest", "left").withColumn(
        "refers_to", F.expr("CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END")
    ).drop("first_id")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes classified pages as monolithic archives, then normalises each; one row per archive: path, records."""

    def monolith(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _filesystem(folder)
        path = f"{root}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def body(stream) -> None:
            nonlocal count
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            for batch in batches:
                for row in zip(
                    *(
                        batch.column(c).to_pylist()
                        for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
                    ),
                    strict=True
                ):
                    stream.write(packer.compress(record(*row)))
                    count += 1
            stream.write(packer.flush())

        system.create_dir(root, recursive=True)
        _put(system, path, body)
        yield pa.RecordBatch.from_pydict(
            {"path": [path] if count else [], "records": pa.array([count] if count else [], pa.int64())},
            pa.schema([("path", pa.string()), ("records", pa.int64())])
        )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = path.replace(".warc.gz", ".members.warc.gz")
                with system.open_input_stream(path, compression=None) as source:
                    index = _put(system, target, lambda out, source=source: normalise(source, out))
                _put(system, f"{target}.idx", lambda out, index=index: out.write("".join(f"{a}\t{n}\n" for a, n in index).encode()))
                yield pa.RecordBatch.from_pydict(
                    {"path": [target], "records": [len(index)]}, pa.schema([("path", pa.string()), ("records", pa.int64())])
                )

    bounded_batches(pages.sparkSession)
    archives = materialize(pages.mapInArrow(monolith, "path string, records long"), "archives")
    apart = archives.repartition(max(1, archives.count()), "path")
    return materialize(apart.mapInArrow(rewrite, "path string, records long"), "members")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Reads every record of the archives through their offset indexes; digests and sizes of responses are taken from the stored payload."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_offset"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}.idx") as stream:
                    index = [tuple(map(int, x.split(b"\t"))) for x in stream.read().splitlines()]
                rows = []
                with system.open_input_file(path) as stream:
                    for at, length in index:
                        stream.seek(at)
                        item = zlib.decompress(stream.read(length), 31)
                        end = item.index(b"\r\n\r\n")
                        head = headers(item[:end])
                        payload = item[end + 4 : end + 4 + int(head["content-length"])]
                        size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and (size, digest) != (
                            len(payload), hashlib.sha256(payload).hexdigest()
                        ):
                            raise ValueError(f"{path} at {at}: the payload isn't what was written")
                        rows.append(
                            (
                                number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to")),
                                path.rpartition("/")[2], at
                            )
                        )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names
                )

    return archives.repartition(max(1, archives.count()), "path").mapInArrow(
        fetch,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
    )


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to a new shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(classify(pages), folder), folder)
