"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a bundle ends with a skippable frame that holds the
seek table (sizes of all frames). The index maps each record to its bundle, the frame's place and the offset in the frame,
so one record costs one ranged read and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, kept

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
#: Up to so many bundle names are sent to all tasks when archives are read.
FEW_BUNDLES = 100_000

#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id bigint, record_id string, bundle string, frame_start bigint, frame_bytes bigint, offset bigint, length bigint"
_FIELDS = [f.split()[0] for f in INDEX.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(record id, WARC record): a response with the payload, or a revisit of the page `refers_to` without it."""
    name = record_id(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~', errors='replace')}")
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(payload), payload)
    else:
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{record_id(refers_to)}>")
        head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record_id(page_id: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, end) of the record at a place in a frame."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines)
    begin, size = stop + 4, int(fields["Content-Length"])
    block = data[begin : begin + size]
    if len(block) != size:
        raise ValueError("the record is cut off")
    return fields, block[block.index(b"\r\n\r\n") + 4 :], begin + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame, from (compressed, raw) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames_of(bundle: bytes) -> Iterator[bytes]:
    """The raw frames of a bundle, found through its seek table."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    table, at = len(bundle) - 9 - 8 * count, 0
    for k in range(count):
        packed, raw = struct.unpack_from("<II", bundle, table + 8 * k)
        yield zstandard.decompress(bundle[at : at + packed], max_output_size=raw)
        at += packed


class _Bundle:
    """One archive in the making; `rows` gets the index rows of its records."""

    def __init__(self, folder: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.store.create_dir(path, recursive=True)
        self.out = self.store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.pending, self.waiting, self.size, self.at = [], [], 0, 0
        self.rows: list[tuple] = []
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.waiting.append((page_id, name, self.size, len(data)))
        self.pending.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.pending:
            return
        packed = self.packer.compress(b"".join(self.pending))
        self.out.write(packed)
        self.rows += [(page, name, self.name, self.at, len(packed), offset, length) for page, name, offset, length in self.waiting]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.pending, self.waiting, self.size = [], [], 0

    def close(self) -> pa.RecordBatch:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], t) for k, t in enumerate(_TYPES)], _FIELDS)


def _written(folder: str, date: str):
    def run(batches):
        bundle = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "sha", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, sha, refers = (c[i].as_py() for c in columns)
                bundle = bundle or _Bundle(folder)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                bundle.add(page, *record(page, url, (html or "").encode(), digest, refers, date))
                if bundle.at >= BUNDLE_BYTES:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages[page_id, url, html] below folder; returns the index of all records.

    Of rows with equal payloads (html in UTF-8, null: empty) of at least min_revisit_bytes bytes, the one with the smallest
    page_id becomes a response and the others revisit it. Smaller payloads are all responses.

    * Rows sharing the smallest page_id and the payload are responses each; if all ids of a payload are null, all are.
    * A null url is left out of the record, other urls are percent-encoded. An empty table writes no bundle.

    folder must be a place that driver and executors share and that pyarrow can write to. A bundle counts only if the index
    lists it: a task that is run again writes bundles of other names, and what the lost one wrote is never read.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"], html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    first = rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    first = first.where("rows > 1").select("sha", "n", "first")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    marked = rows.join(first, ["sha", "n"], "left").select("page_id", "url", "html", "sha", refers.alias("refers_to"))
    return kept(marked.mapInArrow(_written(folder, date), INDEX), "warc-index")


_READ = "bundle string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, payload binary"


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for frame in frames_of(batch.column("content")[i].as_py()):
                    at, rows = 0, []
                    while at < len(frame):
                        fields, payload, at = parse(frame, at)
                        rows.append(_row(fields, payload, with_payload))
                    yield _batch([(batch.column("name")[i].as_py(), *r) for r in rows])

    return run


def _row(fields: dict[str, str], payload: bytes, with_payload: bool) -> tuple:
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    size = len(payload) if kind == "response" else number("X-Payload-Length")
    shown = payload if with_payload and kind == "response" else None
    return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page"), fields.get("WARC-Target-URI"), shown


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def read_archives(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the indexed bundles, frame by frame; payload is null for revisits or if not asked for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    valid = index.select(F.col("bundle").alias("name")).distinct()
    if valid.limit(FEW_BUNDLES + 1).count() <= FEW_BUNDLES:  # a few MB of names: the bundles themselves stay where they are
        valid = F.broadcast(valid)
    return files.join(valid, "name", "left_semi").mapInArrow(_read(with_payload), _READ).drop("bundle")


def fetch(folder: str, wanted: DataFrame) -> DataFrame:
    """The records of the given index rows, by one ranged read each."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with store.open_input_file(f"{path}/{r['bundle']}") as file:
                    file.seek(r["frame_start"])
                    frame = zstandard.decompress(file.read(r["frame_bytes"]))
                fields, payload, _ = parse(frame, r["offset"])
                rows.append((r["bundle"], *_row(fields, payload, True)))
            yield _batch(rows)

    return wanted.mapInArrow(run, _READ)


def archived(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per page, without the payloads."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    index = write_archives(pages, folder, min_revisit_bytes)
    return read_archives(spark, folder, index)
