"""Hashing of words and n-grams as whole numpy arrays, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_BASE = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text that are hashed at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well spread 64-bit hash of each 64-bit number (the finaliser of splitmix64)."""
    h = h + np.uint64((_ODD * (seed + 1)) & (1 << 64) - 1)
    h ^= h >> np.uint64(30)  # in place: the sum above is a copy
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of a string column: first row, last row + 1, bytes, row bounds in the bytes.
    Null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_powers.get("up", ())) < n:
        n = max(n + n // 8, 1 << 16)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", int(_BASE)), ("down", inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end: differences of one running sum."""
    up, down = _power(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] ^ mix((end - start).astype(np.uint64)))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows in a block, and the word bounds of each row.

    A-Z is lower-cased; words are runs without ASCII white space.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    starts = inside.copy()
    starts[1:] &= space[:-1]
    edges = bounds[1:-1][bounds[1:-1] < len(data)]
    starts[edges] = inside[edges]  # a row starts a word of its own
    ends = inside.copy()
    ends[:-1] &= space[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hashes(data, start, end), np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of `k` words of one text; of all of it if it has fewer."""
    k = min(k, len(words))
    return mix(_sums(words, k) ^ mix(np.full(1, k, np.uint64))) if k else words


def _sums(words: np.ndarray, k: int) -> np.ndarray:
    """Sum of the k word hashes from each place on, each times an odd number of its own."""
    n = len(words) - k + 1
    factors = mix(np.arange(k, dtype=np.uint64), 9) | np.uint64(1)
    out = words[:n] * factors[0]
    for j in range(1, k):
        out += words[j:j + n] * factors[j]
    return out


def block_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of word-shingle hashes of the rows of a block, one after the other,
    and their bounds."""
    words, at = word_hashes(data, bounds)
    runs = mix(_sums(words, k) ^ mix(np.full(1, k, np.uint64))) if len(words) >= k else words[:0]
    sets = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        if high - low <= k:
            sets.append(shingle_hashes(words[low:high], k))
            continue
        one = np.sort(runs[low:high - k + 1])
        new = np.empty(len(one), dtype=bool)
        new[0] = True
        np.not_equal(one[1:], one[:-1], out=new[1:])
        sets.append(one[new])
    sizes = np.array([0, *map(len, sets)], dtype=np.int64)
    return np.concatenate(sets) if sets else words[:0], np.cumsum(sizes)


def word_sets(column: pa.Array, k: int, size: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """The sorted set of word-shingle hashes of each row of a string column."""
    for _, _, data, bounds in blocks(column, size):
        sets, at = block_sets(data, bounds, k)
        for low, high in zip(at[:-1], at[1:]):
            yield sets[low:high]
