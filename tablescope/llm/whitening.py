"""Whitening of vectors: leading components by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

COMPONENTS = 32
#: Whole numbers that the entries become: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size, scaled, are set to it: they stay exact as doubles.
MOST = 1 << 52
#: Bits of the lower half of a number, summed apart.
HALF = 26
#: Vectors of the iterated block beyond those wanted, and degree of the filter.
GUARD, DEGREE = 8, 10
#: A wanted component is certified when |V u - e u| is at most this part of the largest e.
TOLERANCE = 1e-13
#: A round must shrink the worst residual this much, or the block is doubled.
SHRINK = 10.0
#: Vectors of a stored block, and partial results that one task or the driver adds up.
BLOCK_ROWS, FAN_IN = 2048, 32


@dataclass
class Fit:
    """n vectors with the sums S (of whole numbers) per dimension, and the components:
    columns of `vectors` with falling `values`; `total` is the trace, `passes` the passes
    over the blocks, `residual` the worst certified one."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    total: float
    passes: int
    residual: float


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """`df` with the vector as doubles, without null vectors and those that hold a null or
    a non-finite entry. Of the others, vectors of the most frequent length stay (of equally
    frequent ones the longest); those of another length can't share a covariance."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = df.withColumn(vec_col, vec).filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).filter(fine)
    lengths = df.groupBy(F.size(vec_col).alias("n")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return df.filter(F.size(vec_col) == (most[0]["n"] if most else 0))


def _whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * c) as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(flat * float(scale)), -MOST, MOST).astype(np.int64)


def _halves(x: np.ndarray) -> np.ndarray:
    """Column sums of the upper and of the lower bits, neither of which can overflow."""
    return np.concatenate([(x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)])


def _added(df: DataFrame, parts: int, kind: str) -> np.ndarray | None:
    """The sum of the arrays in column `part` (binary of `kind`). Added level by level in
    tasks of FAN_IN, so the driver adds no more than FAN_IN arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                x = np.frombuffer(x.as_py(), dtype=kind)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    df = df.select("part")
    while parts > FAN_IN:
        parts = ceil(parts / FAN_IN)
        df = df.repartition(parts).mapInArrow(run, "part binary")
    arrays = [np.frombuffer(r["part"], dtype=kind) for r in df.collect()]
    return np.sum(arrays, axis=0) if arrays else None


class Blocks:
    """Vectors of `df` as whole numbers, written once in blocks of rows: what each pass
    reads. The numbers are kept as 32-bit ones where they fit, else as 64-bit ones."""

    def __init__(self, df: DataFrame, vec_col: str, scale: int, shift: int):
        first = df.select(F.size(vec_col).alias("n")).limit(1).collect()
        self.dim = dim = first[0]["n"] if first else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), BLOCK_ROWS):
                    x = _whole(batch.column(0).slice(at, BLOCK_ROWS), dim, scale)
                    wide = len(x) and max(-x.min(), x.max()) >= 1 << 31
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(x)], pa.int64()), pa.array([bool(wide)]),
                         pa.array([x.astype("<i8" if wide else "<i4").tobytes()]),
                         pa.array([_halves(x).tobytes()])], names=["n", "wide", "x", "part"])

        self.n, self.sums, self.low = 0, [shift] * dim, np.zeros(dim, dtype=np.int64)
        if not dim:
            return
        self.blocks = materialise(df.select(vec_col).mapInArrow(
            run, "n long, wide boolean, x binary, part binary"), "whitening-blocks")
        self.n = self.blocks.agg(F.sum("n")).first()[0]
        self.parts = self.blocks.rdd.getNumPartitions()
        high, low = _added(self.blocks, self.parts, "<i8").reshape(2, dim).tolist()
        sums = [(a << HALF) + b for a, b in zip(high, low)]
        # entries are taken from a whole number near the mean, so that differences are exact
        self.low = np.array([s // self.n for s in sums], dtype=np.int64)
        self.rest = np.array([s % self.n / self.n for s in sums])
        self.sums = [s + shift * self.n for s in sums]

    def _sums(self, one: Callable, kind: str) -> np.ndarray:
        """Sum over all blocks of what `one` makes of a block's rows."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x, wide in zip(batch.column(0), batch.column(1), strict=True):
                    x = np.frombuffer(x.as_py(), dtype="<i8" if wide.as_py() else "<i4")
                    x = one(x.reshape(-1, dim))
                    total = x if total is None else total + x
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, dtype=kind).tobytes()])], names=["part"])

        return _added(self.blocks.select("x", "wide").mapInArrow(run, "part binary"), self.parts, kind)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        low, rest = self.low, self.rest
        return lambda x: (x - low) - rest

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q for the covariance V: one pass that adds up X'(X q) of centred blocks."""
        centre = self.centred()

        def one(x: np.ndarray) -> np.ndarray:
            x = centre(x)
            return x.T @ (x @ q)

        return self._sums(lambda x: one(x).ravel(), "<f8").reshape(self.dim, -1) / self.n

    def trace(self) -> float:
        centre = self.centred()
        return float(self._sums(lambda x: np.array([np.square(centre(x)).sum()]), "<f8")[0]) / self.n

    def second(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the rows projected on the columns of w, centred again."""
        centre, k = self.centred(), w.shape[1]
        mean = self._sums(lambda x: (centre(x) @ w).sum(axis=0), "<f8") / self.n

        def one(x: np.ndarray) -> np.ndarray:
            z = centre(x) @ w - mean
            return (z.T @ z).ravel()

        return self._sums(one, "<f8").reshape(k, k) / self.n


def components(blocks: Blocks, k: int = COMPONENTS, seed: int = 1) -> Fit:
    """The k leading components of the covariance (all, if there are fewer dimensions).

    A block of k + GUARD vectors goes through a Chebyshev polynomial of V, whose three-term
    recurrence is one pass over the data a degree and which is small on the unwanted part
    of the spectrum, from 0 to the block's least Ritz value; then QR and Rayleigh-Ritz.
    Rounds go on until every wanted component has a residual of TOLERANCE times the
    largest value. A round that hardly helps (a spectrum without a gap after the block)
    doubles the block; at all dimensions the block is exact, so the rounds end.

    The driver holds matrices of dimensions by block, never rows.
    """
    dim, passes = blocks.dim, 1
    total = blocks.trace()
    k = min(k, dim)
    rng = np.random.default_rng(seed)

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rayleigh-Ritz in the span of q: values falling, vectors, worst wanted residual."""
        nonlocal passes
        q, _ = np.linalg.qr(q)
        y = blocks.times(q)
        passes += 1
        t = q.T @ y
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        worst = np.linalg.norm(y - q * values, axis=0)[:k].max(initial=0.0)
        return values, q, float(worst)

    def filtered(q: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Chebyshev recurrence on [0, least Ritz value], scaled to 1 at the largest."""
        nonlocal passes
        half = max(values[-1], values[0] * 1e-12) / 2
        sigma = half / (half - values[0])
        tau, last, now = 2 / sigma, q, (blocks.times(q) - half * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            step = 1 / (tau - sigma)
            last, now = now, (blocks.times(now) - half * now) * (2 * step / half) - last * (sigma * step)
            sigma = step
        passes += DEGREE
        return now

    size = min(dim, k + GUARD)
    values, q, worst = ritz(rng.standard_normal((dim, size)))
    while worst > TOLERANCE * max(values[0], 0.0) and size < dim:
        before = worst
        values, q, worst = ritz(filtered(q, values))
        if worst > TOLERANCE * values[0] and worst * SHRINK > before:
            size = min(dim, 2 * size)
            q = np.hstack([q, rng.standard_normal((dim, size - q.shape[1]))])
            values, q, worst = ritz(q)
    return Fit(blocks.n, blocks.sums, q[:, :k], np.maximum(values[:k], 0.0), total, passes, worst)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation (decimal),
    whitened, explained, identity_error.

    An entry c counts as x = floor(scale * c) + shift. deviation is the exact sum over
    dimensions of (n * x - S) ** 2 for sums S; whitened is the centred vector projected on
    the component over the root of its value e; explained is e over the trace;
    identity_error the largest entry of |covariance of whitened - identity|, taken from
    the data. All rows that `usable` keeps are the fit list, repeated ones each. Passes
    read whole numbers from blocks that are written once.

    Null vectors, and those with a null or non-finite entry or of another length than the
    most, are left out. Scaled entries beyond 2 ** 52 count as that. Null and repeated ids
    are kept. A component without variance (e at most 1e-14 of the trace: constant or
    single vectors) has whitened null and explained 0, and no part in identity_error, which
    is 0 if there is no other. Extra columns are ignored. An empty table gives no row.
    """
    kept = usable(df.select(id_col, vec_col), vec_col)
    blocks = Blocks(kept, vec_col, scale, shift)
    key = df.schema[id_col].dataType
    schema = (f"{id_col} {key.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    if not blocks.n:
        return df.sparkSession.createDataFrame([], schema)
    fit = components(blocks, k)
    live = fit.values > 1e-14 * fit.total
    weights = np.where(live, fit.vectors / np.sqrt(np.where(live, fit.values, 1.0)), 0.0)
    error = blocks.second(weights[:, live]) - np.eye(int(live.sum()))
    error = float(np.abs(error).max()) if error.size else 0.0
    share = np.where(live, fit.values / fit.total if fit.total else 0.0, 0.0)
    n, dim, low, centre, width = fit.n, blocks.dim, blocks.low, blocks.centred(), len(fit.values)
    rest = np.array([s - (shift + int(m)) * n for s, m in zip(fit.sums, low)], dtype=object)
    small = np.abs(rest).max(initial=0) < 1 << 62

    def deviations(x: np.ndarray) -> list[int]:
        """Exact: in machine numbers where the largest possible sum fits, else in Python's."""
        off = x - low
        if small and (n * int(np.abs(off).max(initial=0)) + n) ** 2 * dim < 1 << 63:
            return np.square(n * off - rest.astype(np.int64)).sum(axis=1).tolist()
        return [sum(y * y for y in row) for row in (n * off.astype(object) - rest).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _whole(part.column(1), dim, scale)
                rows = len(x)
                z = centre(x) @ weights
                every = pa.array(np.repeat(np.arange(rows), width))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(every), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * width, n)), pa.array(deviations(x), pa.decimal128(38, 0)).take(every),
                     pa.array(z.ravel(), mask=np.tile(~live, rows)), pa.array(np.tile(share, rows)),
                     pa.array(np.full(rows * width, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select(id_col, vec_col).mapInArrow(run, schema)
