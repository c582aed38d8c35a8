"""WARC archives with revisits, and a normaliser for archives gzipped as one stream.

``mark_revisits``: of the records with equal payloads of at least ``least`` bytes the one with the
largest id is the response and the others revisit it; smaller payloads are all responses.
``write_archives``: each partition writes files below a shared folder, one gzip stream a file.
``normalise``: inflates such a file once, in bounded pieces, writes every record as a gzip member of
its own, and beside it a sidecar index (offset, length, id, type, digest).
``read_archives``: reads records through the index, one member at a time.

Files are written under a temporary name and moved when complete; a lost or repeated task writes
new files, and only those named in its rows are read.  Digests are SHA-1 in lower-case hex.

Nulls: a null payload is an empty one.  A null id is smaller than any other: its record revisits the
group's response, and is itself a response where all ids of the group are null.  Repeated rows are each a record; those with the largest id
are all responses.  Extra columns are ignored.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import settled, shared_dir

LEAST = 1000
FILE_BYTES = 64 << 20
SALTS = 32
# Fixed value: the date of all records; the tables have none.
DATE = "2024-01-01T00:00:00Z"

# ---------------------------------------------------------------- decisions


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html`` with ``payload_digest, payload_bytes, record_type, refers_to``.

    Only ids and digests meet in the grouping; the records are then dealt by digest and a salt, so
    copies of one page spread over ``SALTS`` tasks.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumns({"payload_digest": F.sha1(body), "payload_bytes": F.length(body).cast("long")})
    groups = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(groups, ["payload_digest", "payload_bytes", "salt"], "left")
    revisit = F.col("chosen").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("chosen")))
    return joined.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("chosen")).alias("refers_to"),
    )


# ---------------------------------------------------------------- records


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, html: str | None, kind: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the payload."""
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    name = "null" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>"),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", name),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes; holds one record and one piece at a time."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"\r\nContent-Length: *(\d+)", bytes(held[: end + 2]), re.I)
                if not length:
                    raise ValueError("a record without a length")
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the stream ends inside a record")


def inflate(read, size: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members."""
    machine = zlib.decompressobj(31)
    while data := read(size):
        while data:
            out = machine.decompress(data, size)
            if out:
                yield out
            data = machine.unconsumed_tail
            if machine.eof:
                data = machine.unused_data
                machine = zlib.decompressobj(31)
    if rest := machine.flush():
        yield rest


# ---------------------------------------------------------------- files


def _open(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _gzip(level: int = 6):
    return zlib.compressobj(level, zlib.DEFLATED, 31)


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes marked pages; one row per file: ``path, records, bytes``.  Each is one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        out = name = machine = None
        count = size = 0

        def close() -> pa.RecordBatch:
            out.write(machine.flush())
            out.close()
            system.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, machine, count, size = f"{uuid.uuid4().hex}.warc.gz", _gzip(), 0, 0
                    out = system.open_output_stream(f"{base}/{name}.part", compression=None)
                data = record(row["page_id"], row["url"], row["html"], row["record_type"], row["payload_digest"], row["refers_to"])
                out.write(machine.compress(data))
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.select("page_id", "url", "html", "record_type", "payload_digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each single-stream file (``path`` below folder) with one member per record and a
    sidecar; rows: ``path, sidecar, records``, names below folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for b in batches:
            for old in b.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.members.warc.gz"
                at = count = 0
                with system.open_input_stream(f"{base}/{old}", compression=None) as source, system.open_output_stream(f"{base}/{name}.part", compression=None) as out, system.open_output_stream(f"{base}/{name}.idx.part", compression=None) as index:
                    for data in split_records(inflate(source.read)):
                        machine = _gzip()
                        member = machine.compress(data) + machine.flush()
                        fields, _ = parse_record(data)
                        out.write(member)
                        line = {"offset": at, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        at, count = at + len(member), count + 1
                for part in (name, f"{name}.idx"):
                    system.move(f"{base}/{part}.part", f"{base}/{part}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{name}.idx"]), pa.array([count], pa.int64())], ["path", "sidecar", "records"])

    return files.select("path").mapInArrow(run, "path string, sidecar string, records long")


def read_archives(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record, read through the sidecar: ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, path, offset`` (and ``payload``).  Digests of responses are computed from
    the bytes read; a response whose bytes do not match its header is an error."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"
    if with_payload:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for b in batches:
            for path, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[list] = []
                with system.open_input_file(f"{base}/{path}") as data, system.open_input_stream(f"{base}/{sidecar}", compression=None) as index:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        fields, block = parse_record(zlib.decompress(data.read(entry["length"]), 31))
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            digest, stated = hashlib.sha1(payload).hexdigest(), digest
                            if digest != stated or len(payload) != size:
                                raise ValueError(f"{path} at {entry['offset']}: the payload does not match its header")
                        name, target = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                        row = [None if name == "null" else int(name), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], None if target in (None, "None") else int(target), path, entry["offset"]]
                        rows.append(row + ([payload] if with_payload else []))
                        if len(rows) >= (256 if with_payload else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "sidecar").mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> tuple[str, DataFrame]:
    """Folder and file list of the normalised archives of all pages."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    written = settled(write_archives(mark_revisits(pages), folder), "warc-files")
    members = normalise(written.repartition(max(1, min(written.count(), 4096))), folder)
    members = settled(members, "warc-members")
    system, base = _open(folder)
    for row in written.select("path").toLocalIterator():  # the streams have been rewritten; free their space
        system.delete_file(f"{base}/{row['path']}")
    return folder, members
