"""Token ids in binary files: blocks of ids transposed to bit or byte planes.

A file is MAGIC, the planes of its chunks, and a directory at the end:

    chunk      the planes of up to `block` ids, lowest first, each a Zstandard frame of its
               own; a plane of zeros alone takes no bytes
    directory  a Zstandard frame of arrays, little-endian: per chunk its offset (u64), its
               number of ids (u32) and the size of each plane (u32 each, PLANES of them);
               per document whether it has a key (u8), its key (i64), its number of ids (i64)
    tail       u64 offset of the directory, u64 chunks, u64 documents, u64 ids, u32 block,
               u8 planes per id (32 bits or 4 bytes), MAGIC

Ids are unsigned 32-bit. In a file the ids of the documents follow each other without
gaps, so any run of ids is found from the directory and needs only the chunks it touches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise
from .tokens import encode, words_of
from .warc import open_fs

MAGIC = b"IDPLANE1"
TAIL = struct.Struct("<QQQQIB8s")
END_ID = 2
#: Ids of a block, and ids or documents of a file, after which a new one begins. Files
#: hold whole documents, so one longer than a file makes a file of its own.
BLOCK, FILE_IDS, FILE_DOCS = 65_536, 1 << 24, 1 << 20
#: Kinds of planes, by name: planes of an id.
KINDS = {"bit": 32, "byte": 4}
LEVEL = 3
#: Bytes of ids that a batch of rows of `read_documents` holds before it is passed on.
BATCH_BYTES = 8 << 20
INDEX_SCHEMA = "file string, task int, part int, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids: plane k has bit (byte) k of each id, in order."""
    raw = ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def from_planes(planes: list[bytes | None], n: int, kind: str) -> np.ndarray:
    """The ids of a block; None stands for a plane of zeros."""
    if kind == "byte":
        raw = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                raw[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").ravel()


class PlaneWriter:
    """Writes a file; holds the ids of one block and three numbers per document."""

    def __init__(self, store, path: str, kind: str = "byte", block: int = BLOCK):
        self.stream, self.path = store.open_output_stream(path, compression=None), path
        self.kind, self.block = kind, block
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[tuple] = []
        self.docs: list[tuple[bool, int, int]] = []
        self.stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, key: int | None, *parts: np.ndarray) -> None:
        """Append a document: the ids of its parts."""
        n = sum(map(len, parts))
        self.docs.append((key is not None, key or 0, n))
        self.waiting += parts
        self.n_waiting += n
        self.n_ids += n
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._chunk(ids[at:at + self.block])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        sizes, start = [], self.at
        for plane in to_planes(ids, self.kind):
            packed = self.packer.compress(plane) if plane.strip(b"\0") else b""
            self.stream.write(packed)
            self.at += len(packed)
            sizes.append(len(packed))
        self.chunks.append((start, len(ids), *sizes))

    def close(self) -> int:
        """Write what waits and the directory; gives the size of the file."""
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        table = np.array(self.chunks, dtype=np.uint64).reshape(len(self.chunks), 2 + KINDS[self.kind])
        known, keys, sizes = zip(*self.docs) if self.docs else ((), (), ())
        packed = self.packer.compress(b"".join(x.tobytes() for x in (
            table[:, 0].astype("<u8"), table[:, 1].astype("<u4"), table[:, 2:].astype("<u4"),
            np.array(known, dtype=np.uint8), np.array(keys, dtype="<i8"), np.array(sizes, dtype="<i8"))))
        self.stream.write(packed)
        self.stream.write(TAIL.pack(self.at, len(self.chunks), len(self.docs), self.n_ids, self.block,
                                    KINDS[self.kind], MAGIC))
        self.stream.close()
        return self.at + len(packed) + TAIL.size


class PlaneReader:
    """Random access to the ids of a file. `known`, `keys`, `sizes`: an entry per document."""

    def __init__(self, file: pa.NativeFile):
        size = file.size()
        if size < TAIL.size:
            raise ValueError("no plane file")
        file.seek(size - TAIL.size)
        at, n_chunks, n_docs, self.n_ids, self.block, width, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("no plane file")
        self.file, self.kind = file, {n: k for k, n in KINDS.items()}[width]
        file.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(file.read(size - TAIL.size - at))
        parts, done = [], 0
        for kind, n in (("<u8", n_chunks), ("<u4", n_chunks), ("<u4", n_chunks * width), ("u1", n_docs),
                        ("<i8", n_docs), ("<i8", n_docs)):
            parts.append(np.frombuffer(raw, dtype=kind, count=n, offset=done))
            done += parts[-1].nbytes
        self.offsets, self.counts, planes, self.known, self.keys, self.sizes = parts
        self.planes = planes.reshape(n_chunks, width)
        self.held: tuple[int, np.ndarray] | None = None

    def chunk(self, k: int) -> np.ndarray:
        """The ids of chunk k; the last one is remembered."""
        if self.held is None or self.held[0] != k:
            sizes = self.planes[k].tolist()
            self.file.seek(int(self.offsets[k]))
            raw, planes, at = self.file.read(sum(sizes)), [], 0
            unpack = zstandard.ZstdDecompressor().decompress
            for n in sizes:
                planes.append(unpack(raw[at:at + n]) if n else None)
                at += n
            self.held = k, from_planes(planes, int(self.counts[k]), self.kind)
        return self.held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place `start` to `stop` of the file; reads the chunks between alone."""
        stop = min(stop, self.n_ids)
        parts = []
        while start < stop:
            k, low = divmod(start, self.block)
            part = self.chunk(k)[low:low + stop - start]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id",
              text_col: str = "text", end_id: int = END_ID, kind: str = "byte",
              block: int = BLOCK, file_ids: int = FILE_IDS, tasks: int | None = None) -> DataFrame:
    """Write the ids of every text, `end_id` after each, below `folder`; gives the index,
    one row per file: file, task, part, n_docs, n_ids, n_bytes, start.

    Documents lie in ascending order of `id_col` (a whole number) over all files. They are
    sorted by range partitions, by id, hash of the text and row, so an id that a third of
    the rows repeat still spreads over tasks; then a task encodes and writes its range,
    holding one block of ids. `start`, the number of ids in the files before, is a running
    sum over the index, which has a row per file. A task writes files under the name of
    its attempt and reports them in the index, which Spark commits, so a lost or
    speculative attempt leaves a file that no index row names. `tasks` sets the number of
    ranges (else the session's shuffle partitions).

    A null or empty text is `end_id` alone. Null ids come first and are kept. Rows that
    repeat an id are documents of their own, in the order of the hash of their text.
    Extra columns are ignored. An empty table writes no file and gives an empty index.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    order = [F.col("key"), F.col("_tie"), F.col("_row")]
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words = TaskContext.get(), words_of(tokenizer_path)
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        end, writer, found = np.array([end_id], dtype=np.uint32), None, []

        def close() -> None:
            size = writer.close()
            found.append((writer.path.rpartition("/")[2], task.partitionId(), len(found),
                          len(writer.docs), writer.n_ids, size))

        for batch in batches:
            for key, ids in zip(batch.column(0), encode(batch.column(1), words), strict=True):
                if writer is None:
                    writer = PlaneWriter(store, f"{root}/ids-{task.partitionId():06d}-{len(found):04d}-"
                                                f"{task.taskAttemptId()}.planes", kind, block)
                writer.add(key.as_py(), ids, end)
                if writer.n_ids >= file_ids or len(writer.docs) >= FILE_DOCS:
                    close()
                    writer = None
        if writer is not None:
            close()
        if found:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), kinds, strict=True)],
                names=["file", "task", "part", "n_docs", "n_ids", "n_bytes"])

    files = materialise(dealt.sortWithinPartitions(*order).select("key", "text")
                        .mapInArrow(run, INDEX_SCHEMA), "id-files")
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "id-index")


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """The documents of the files that `index` names: key, start (ids of all documents
    before it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    Files are dealt to tasks by name, as many as there are files, up to the session's
    shuffle partitions; a task reads chunk after chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        for batch in batches:
            for name, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    yield from documents(PlaneReader(file), start)

    def documents(reader: PlaneReader, start: int) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(reader.sizes)
        first = 0
        while first < len(ends):
            low = int(ends[first] - reader.sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, low + BATCH_BYTES // 4, "right")))
            sizes = reader.sizes[first:last]
            data = reader.ids(low, int(ends[last - 1]))
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), last - first, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(reader.keys[first:last], pa.int64(), mask=reader.known[first:last] == 0),
                 pa.array(start + low + at[:-1], pa.int64()), pa.array(sizes, pa.int64()),
                 ids.cast(pa.binary())], names=["key", "start", "n_tokens", "ids"])
            first = last

    spark = index.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, index.count()))
    return (index.select("file", "start").repartition(tasks, "file")
            .mapInArrow(run, "key long, start long, n_tokens long, ids binary"))
