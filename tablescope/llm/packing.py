"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from .tokens import BLOCK_BYTES, CACHED_WORDS, encode, words_of

WINDOW = 1024
END_ID = 0
#: Windows that may be partly filled at a time in one task; beyond that they are merged.
MAX_OPEN = 4096
ROWS_OUT = 2_000


class SumOfSquares:
    """Level array of partly filled windows (Csirik et al., "On the Sum-of-Squares
    Algorithm for Bin Packing"): an item goes to the level, or to a new window, after which
    the sum of the squared numbers of windows per level is least; ties to the fullest."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level(self, size: int) -> int:
        used = np.flatnonzero(self.count[1:self.window - size + 1]) + 1
        after = np.where(used + size < self.window, 2 * self.count[used + size] + 1, 0)
        change = after - 2 * self.count[used] + 1
        best, level = (2 * self.count[size] + 1 if size < self.window else 0), 0
        if len(used):
            at = len(used) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = int(used[at])
        return level

    def place(self, piece: tuple, size: int) -> list | None:
        """Add a piece; gives the window if that filled it."""
        at = self.level(size)
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if at + size == self.window:
            return window
        self.open[at + size].append(window)
        self.count[at + size] += 1
        self.n_open += 1
        return None

    def drain(self) -> list[tuple]:
        """The pieces of all partly filled windows, fullest first; none stays open."""
        pieces = [p for level in reversed(self.open) for w in level for p in w]
        self.open = [[] for _ in self.open]
        self.count[:] = 0
        self.n_open = 0
        return pieces


def _recut(pieces: list[tuple], window: int) -> Iterator[tuple[list[tuple], bool]]:
    """Pieces cut into full windows; the rest comes last, marked False."""
    now, room = [], window
    for key, start, ids, total in pieces:
        while ids:
            take = min(room, len(ids) // 4)
            now.append((key, start, ids[:take * 4], total))
            start, ids, room = start + take, ids[take * 4:], room - take
            if not room:
                yield now, True
                now, room = [], window
    if now:
        yield now, False


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES,
         keep_words: bool = True, most_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    A document is its token ids followed by `end_id`; a null or empty text is `end_id`
    alone. Whole windows of a long document become sequences at once. What is left of it
    goes, in the order of arrival, to the fill level that sum-of-squares picks. Every task
    packs the rows it reads: no shuffle, no order between tasks, and memory for at most
    MAX_OPEN partly filled windows. When there are more, and at the end of the task, their
    pieces are cut anew into full windows; the last one, of under `window` tokens, is cut
    into sequences of a power of two, which need no padding. So there is no padding, and
    a document is cut inside a window only there.

    Memory of a worker: 60 times `block_bytes`, and up to `most_words` words that it
    remembers, for its next task, too, unless `keep_words` is false; less of any costs time.

    `tokenizer_path` is a tokenizer file; strings of its added tokens in a text become those
    tokens. Rows that repeat an id are packed each on its
    own; null ids are carried along; extra columns are ignored; an empty table gives an
    empty result.
    """
    key_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, key_type), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = words_of(tokenizer_path, most_words), SumOfSquares(window)
        end = np.array([end_id], dtype="<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        arrow: list[pa.DataType] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal next_id
            offset = 0
            for key, start, ids, total in pieces:
                length = len(ids) // 4
                out.append((key, start, length, ids, total, next_id, offset))
                offset += length
            next_id += 1

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), arrow, strict=True)], names=schema.names)
            out.clear()
            return batch

        def merge(last: bool) -> None:
            for pieces, full in _recut(packer.drain(), window):
                if full:
                    put(pieces)
                    continue
                while last and (left := sum(len(p[2]) // 4 for p in pieces)):
                    parts = list(_recut(pieces, 1 << (left.bit_length() - 1)))
                    put(parts[0][0])
                    pieces = [p for part, _ in parts[1:] for p in part]
                for piece in pieces:
                    packer.place(piece, len(piece[2]) // 4)

        for batch in batches:
            arrow = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(),
                     pa.int64(), pa.int64()]
            for key, ids in zip(batch.column(0), encode(batch.column(1), words, block_bytes), strict=True):
                ids = ids.astype("<u4").tobytes() + end
                key, total = key.as_py(), len(ids) // 4
                whole = total // window * window
                for at in range(0, whole, window):
                    put([(key, at, ids[at * 4:(at + window) * 4], total)])
                if whole < total and (full := packer.place((key, whole, ids[whole * 4:], total),
                                                           total - whole)):
                    put(full)
                if packer.n_open > MAX_OPEN:
                    merge(last=False)
                if len(out) >= ROWS_OUT:
                    yield rows()
        merge(last=True)
        if out:
            yield rows()
        if not keep_words:
            words.clear()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
