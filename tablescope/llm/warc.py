"""WARC archives as seekable Zstandard bundles, with revisits for equal payloads."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from math import ceil
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, materialise

#: Bytes of records in a frame before it is closed, and of frames in a bundle.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 512 << 20
#: Packed bytes that a task reads back.
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable Zstandard format and of WARC
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-record:"

INDEX_SCHEMA = ("record_key long, record_type string, refers_to long, bundle string, frame int, "
                "frame_offset long, frame_bytes long, record_offset long, record_bytes long")
RECORD_SCHEMA = ("record_key long, url string, record_type string, refers_to long, "
                 "payload_digest string, payload_bytes long, payload binary")


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The store of `path`, by its scheme; a path without one is a local or mounted folder."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(key: int | None, url: str | None, kind: str, refers_to: int | None,
                 payload: bytes, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head of its full payload, without it."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_URN}{key}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        # only control characters are escaped, and the sign that escapes them
        head.append("WARC-Target-URI: " + "".join(
            quote(c) if c < " " or c in "%\x7f" else c for c in url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple]:
    """Rows of RECORD_SCHEMA from a frame. Raises if a payload does not match its digest."""
    from urllib.parse import unquote

    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}: {version[:40]!r}")
        head = dict(line.split(": ", 1) for line in lines)
        body = end + 4
        length = int(head["Content-Length"])
        http_end = data.index(b"\r\n\r\n", body) + 4
        http = dict(x.split(": ", 1) for x in data[body:http_end - 4].decode().split("\r\n")[1:])
        payload = data[http_end:body + length]
        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != said:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        number = lambda name: (None if (x := head[name][len(RECORD_URN) + 1:-1]) == "None"
                               else int(x))
        url = head.get("WARC-Target-URI")
        yield (number("WARC-Record-ID"), None if url is None else unquote(url), kind,
               number("WARC-Refers-To") if kind == "revisit" else None, said,
               int(http["Content-Length"]), payload if kind == "response" else None)
        at = body + length + 4


class BundleWriter:
    """Independent frames followed by a seek table in a skippable frame."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.stream, self.path = store.open_output_stream(path, compression=None), path
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.at = 0

    def frame(self, data: bytes) -> tuple[int, int]:
        """Write a frame: its offset and its size in the file."""
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)
        self.stream.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, size in the file, size unpacked) of each frame, from the end of the file."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    table, frames, at = file.read(n * width), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        frames.append((at, packed, plain))
        at += packed
    return frames


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0, date: str = DATE,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of `pages` below `folder`; gives the index, one row per record.

    A null payload is empty. Of records with equal payloads of at least
    `min_revisit_bytes`, the one with the largest id is the response and the others
    revisit it; equality is by SHA-1 and length. Every task writes bundles of its own
    under the name of its attempt and reports them in the index, which Spark commits: a
    lost or speculative attempt leaves a file that no index row names. A task holds one
    frame. Payloads are only moved if the groups of equal ones don't fit a broadcast.

    Rows with null ids are records without a number (never preferred as response unless
    the whole group has none); rows that repeat id and payload are all responses. Null
    urls have no target header. Extra columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"),
                        payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"),
                        F.octet_length(payload).alias("size"))
    equal = (rows.filter(F.col("size") >= min_revisit_bytes).groupBy("sha", "size")
             .agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("response"))
             .filter("n > 1").drop("n"))
    equal = bounded(materialise(equal, "warc-equal"))
    other = F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response"))
    rows = rows.join(equal, ["sha", "size"], "left").select(
        "key", "url", "payload", F.when(other, F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        writer, n_bundles, waiting, parts, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal writer, n_bundles, waiting, parts, size
            if writer is None:
                writer = BundleWriter(store, f"{root}/bundle-{task.partitionId():05d}-"
                                             f"{task.taskAttemptId()}-{n_bundles:04d}.warc.zst")
                n_bundles += 1
            name = writer.path.rpartition("/")[2]
            offset, packed = writer.frame(b"".join(parts))
            number = len(writer.sizes) - 1
            columns = list(zip(*waiting))
            const = lambda v, t: pa.array([v] * len(waiting), t)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.int64()), const(name, pa.string()),
                 const(number, pa.int32()), const(offset, pa.int64()), const(packed, pa.int64()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["record_key", "record_type", "refers_to", "bundle", "frame",
                       "frame_offset", "frame_bytes", "record_offset", "record_bytes"])
            waiting, parts, size = [], [], 0
            if writer.at >= bundle_bytes:
                writer.close()
                writer = None
            return batch

        for batch in batches:
            for key, url, text, refers_to in zip(*map(iter, batch.columns), strict=True):
                key, refers_to = key.as_py(), refers_to.as_py()
                kind = "response" if refers_to is None else "revisit"
                data = record_bytes(key, url.as_py(), kind, refers_to,
                                    text.as_py().encode(), date)
                waiting.append((key, kind, refers_to, size, len(data)))
                parts.append(data)
                size += len(data)
                if size >= frame_bytes:
                    yield flush()
        if waiting:
            yield flush()
        if writer is not None:
            writer.close()

    return materialise(rows.mapInArrow(run, INDEX_SCHEMA), "warc-index")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)],
        names=["record_key", "url", "record_type", "refers_to", "payload_digest",
               "payload_bytes", "payload"])


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that `index` names, frame by frame by their seek tables.

    The frames are dealt to as many tasks as their bytes ask for. The number is explicit,
    as adaptive execution would merge rows that are so short into one task.
    """
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    rows = [(name, *row[:3]) for row in seek_table(file)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                        (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["bundle", "at", "packed", "plain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        file, opened = None, None
        for batch in batches:
            for name, offset, packed, plain in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != opened:
                    if file is not None:
                        file.close()
                    file, opened = store.open_input_file(f"{root}/{name}"), name
                file.seek(offset)
                data = zstandard.ZstdDecompressor().decompress(file.read(packed), plain)
                yield _record_batch(list(parse_records(data)))
        if file is not None:
            file.close()

    known = index.select("bundle", "frame_offset", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0]
    tasks = max(1, ceil((known or 0) / READ_BYTES))
    dealt = index.select("bundle").distinct().repartition(tasks, "bundle").mapInArrow(
        frames, "bundle string, at long, packed long, plain long")
    return (dealt.repartition(tasks, "bundle", "at").sortWithinPartitions("bundle", "at")
            .mapInArrow(run, RECORD_SCHEMA))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows alone, such as `index.filter(...)`: a task opens
    a bundle, reads the frames it needs once and cuts the records out by their offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        file, at, data = None, (None, None), b""
        for batch in batches:
            found = []
            for name, offset, packed, start, length in zip(*[c.to_pylist() for c in batch.columns],
                                                          strict=True):
                if name != at[0]:
                    if file is not None:
                        file.close()
                    file = store.open_input_file(f"{root}/{name}")
                if (name, offset) != at:
                    file.seek(offset)
                    data, at = zstandard.ZstdDecompressor().decompress(file.read(packed)), (name, offset)
                found += parse_records(data[start:start + length])
            if found:
                yield _record_batch(found)
        if file is not None:
            file.close()

    wanted = index.select("bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes")
    return (wanted.repartition("bundle", "frame_offset")
            .sortWithinPartitions("bundle", "frame_offset", "record_offset")
            .mapInArrow(run, RECORD_SCHEMA))


def archive(spark: SparkSession, pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write `pages` below `folder` and read every record back from the archives."""
    return read_bundles(write_bundles(pages, folder, **options), folder)
