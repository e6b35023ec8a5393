"""Size-aware heavy-light join on the Jaccard similarity of word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import block_sets, blocks, mix, word_sets
from .candidates import SKETCH_FIELDS, open_buckets, similar_links, sketch_batch
from .common import bounded, discard, materialise

SHINGLE = 5
#: Bytes of texts whose shingles are hashed at a time; the arrays of a block are 60 times that.
TEXT_BYTES = 1 << 18
#: Similarity as a fraction: intersection * DEN >= NUM * union.
NUM, DEN = 4, 5
#: Sets up to this size may be light; the cost decides.
MOST_LIGHT = 24
#: Cost of a posting of a segment against one of a subset: a segment is less selective.
SEGMENT_COST = 1.5
#: Parts of the keys that are shuffled one after the other, each by a pass over the texts.
#: All keys together take more disk than the texts.
PASSES = 3
#: Seed of the checksum of a set that is its id.
ID_SEED = 11
#: Cells of the marks of a set, at least and at most. Between them they are over twice its
#: elements, as the sketches of `candidates` tell nothing of sets of many thousands.
LEAST_CELLS, MOST_CELLS = 1 << 10, 1 << 20
#: Sets that a task remembers so as not to give their keys again.
SEEN_SETS = 1 << 17


def overlap(n: int, m: int) -> int:
    """Least intersection of similar sets of sizes n and m: x >= s / (1 + s) * (n + m)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def partners(n: int) -> range:
    """Sizes that a set similar to one of size n can have."""
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


def subset_sizes(n: int) -> list[int]:
    """The subset sizes that a light set of size n enumerates: the overlaps with any partner."""
    return sorted({overlap(n, m) for m in partners(n) if overlap(n, m) <= n})


def light_cost(n: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n))


def segment_schemes(n: int) -> list[tuple[int, int, int]]:
    """(scheme, segments, most differences) of a heavy set of size n.

    Sizes fall into classes [2**c, 2**(c+1)). Partners of one class meet in scheme 2c,
    partners on both sides of the border 2**c in scheme 2c - 1. A scheme deals shingles
    by hash to more segments than similar sets of its sizes can have differences, so that
    some segment holds the same shingles in both.
    """
    c = n.bit_length() - 1
    low, high = 1 << c, 1 << (c + 1)
    found = [(2 * c, _segments(2 * (high - 1)), (n + min(high - 1, DEN * n // NUM)) // 9)]
    if -(-NUM * n // DEN) < low:
        found.append((2 * c - 1, _segments(low - 1 + DEN * (low - 1) // NUM), (2 * n - 1) // 9))
    if DEN * n // NUM >= high:
        found.append((2 * c + 1, _segments(high - 1 + DEN * (high - 1) // NUM),
                      (n + DEN * n // NUM) // 9))
    return found


def _segments(both: int) -> int:
    """Segments for pairs whose sizes add up to `both` at most: one more than they can
    differ in ((1 - s) / (1 + s) of the sum), and a reserve for empty segments."""
    return both // 9 + 1 + both // 50 + 1


def boundary(sizes: dict[int, int]) -> int:
    """The largest light size, where the postings of the given numbers of sets are fewest."""
    def cost(b: int) -> float:
        light = sum(k * light_cost(n) for n, k in sizes.items() if n <= b)
        heavy = sum(k * SEGMENT_COST * sum(s for _, s, _ in segment_schemes(n))
                    for n, k in sizes.items() if -(-NUM * (b + 1) // DEN) <= n)
        return light + heavy

    return min(range(4, MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def keys_of(sets: np.ndarray, bounds: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of sets of shingle hashes, such that similar, unequal sets share one:
    (row, key) of all. `sets` holds the sets one after the other."""
    sizes = np.diff(bounds)
    rows, keys = [], []
    for row in np.flatnonzero((sizes > 0) & (sizes <= light)):
        n = int(sizes[row])
        marks = mix(sets[bounds[row]:bounds[row + 1]], 1)
        for c in subset_sizes(n):
            out = np.array(list(combinations(range(n), n - c)), dtype=np.int64).reshape(comb(n, c), n - c)
            sums = marks.sum(dtype=np.uint64) - marks[out].sum(axis=1, dtype=np.uint64)
            keys.append(mix(sums, 1000 + c))
            rows.append(np.full(len(out), row))
    heavy = np.flatnonzero(sizes >= -(-NUM * (light + 1) // DEN))
    schemes = {n: segment_schemes(n) for n in set(sizes[heavy].tolist())}
    for slot in range(3):
        own = np.array([r for r in heavy if len(schemes[int(sizes[r])]) > slot], dtype=np.int64)
        if not len(own):
            break
        scheme, segments, differ = (np.array(x, dtype=np.int64) for x in
                                    zip(*(schemes[int(sizes[r])][slot] for r in own)))
        n = sizes[own]
        which = np.repeat(np.arange(len(own)), n)
        tokens = sets[np.repeat(bounds[own] - np.cumsum(n) + n, n) + np.arange(len(which))]
        seed = mix(scheme.astype(np.uint64), 3)
        at = (mix(tokens ^ seed[which], 4) % segments.astype(np.uint64)[which]).astype(np.int64)
        first = np.cumsum(segments) - segments
        sums = np.zeros(int(segments.sum()), dtype=np.uint64)
        flat = first[which] + at
        np.add.at(sums, flat, mix(tokens, 2))
        used = np.zeros(len(sums), dtype=bool)
        used[flat] = True
        owner = np.repeat(np.arange(len(own)), segments)
        name = mix((np.arange(len(sums)) - first[owner]).astype(np.uint64) ^ seed[owner], 5)
        # equal segments might all be empty ones: then these count, too
        n_empty = segments - np.add.reduceat(used, first)
        wanted = used | (n_empty >= segments - differ)[owner]
        key = mix(np.where(used, sums ^ name, mix(name, 6)), 7)
        keys.append(key[wanted])
        rows.append(own[owner[wanted]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _checksum(sets: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit checksum of each set: the sum of hashes of its elements."""
    run = np.zeros(len(sets) + 1, dtype=np.uint64)
    np.cumsum(mix(sets, seed), out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, text_key, n, hi, lo): size and 128-bit checksum of each row's shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in blocks(batch.column("text"), TEXT_BYTES):
                sets, at = block_sets(data, bounds, k)
                sums = [_checksum(sets, at, seed) for seed in (ID_SEED, 12)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, last - first) for c in ("doc", "text_key")]
                    + [pa.array(np.diff(at)), *map(_signed, sums)],
                    names=["doc", "text_key", "n", "hi", "lo"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, "
                                "text_key long, n long, hi long, lo long")


def _keys(texts: DataFrame, k: int, light: int, turn: int = 0, passes: int = 1) -> DataFrame:
    """(id, key) of the sets of all texts, the id being a checksum of the set; of `passes`
    parts of the keys that of this turn. A task gives the keys of equal sets once, as far
    as it remembers them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column("text"), TEXT_BYTES):
                sets, at = block_sets(data, bounds, k)
                ids, sizes = _checksum(sets, at, ID_SEED), np.diff(at)
                fresh = np.zeros(len(ids), dtype=bool)
                for row, one in enumerate(ids.tolist()):
                    if one not in seen:
                        seen.add(one)
                        fresh[row] = True
                if len(seen) > SEEN_SETS:
                    seen.clear()
                rows, keys = keys_of(sets[np.repeat(fresh, sizes)],
                                     np.concatenate([[0], np.cumsum(sizes[fresh])]), light)
                due = keys % np.uint64(passes) == turn
                yield pa.RecordBatch.from_arrays(
                    [_signed(ids[fresh][rows[due]]), _signed(keys[due])], names=["id", "key"])

    return texts.select("text").mapInArrow(run, "id long, key long")


def marks(one: np.ndarray) -> bytes:
    """The parity of the number of a set's elements in each cell, as bits. The cells are a
    power of two, so that marks of more cells fold to fewer (`marks_differ`)."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * len(one)).bit_length()))
    at = (mix(one, 78) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1).tobytes()


def marks_differ(x: bytes, y: bytes) -> int:
    """Cells in which the marks of two sets differ: no more than the sets do in elements."""
    x, y = (np.frombuffer(m, dtype=np.uint64) for m in (x, y))
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _sketched(texts: DataFrame, k: int) -> DataFrame:
    """Sketches and marks of texts (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in blocks(batch.column("text"), TEXT_BYTES):
                sets, at = block_sets(data, bounds, k)
                found = sketch_batch(batch.column("id").slice(first, last - first), sets, at)
                of = pa.array([marks(sets[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())
                yield found.append_column("marks", of)

    return texts.select("id", "text").mapInArrow(run, SKETCH_FIELDS + ", marks binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, size_a, marks_a, size_b, marks_b) that their marks don't rule out, as
    (a, b): similar sets of n and m elements differ in at most (n + m) / 9."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [9 * marks_differ(x.as_py(), y.as_py()) <= n.as_py() + m.as_py() for x, y, n, m in
                    zip(*(batch.column(c) for c in ("marks_a", "marks_b", "size_a", "size_b")))]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "size_a", "marks_a", "size_b", "marks_b").mapInArrow(run, "a long, b long")


def _beside(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of `items` (id, ...) of both, as ..._a and ..._b. Few
    pairs go to the items, so that only the items of pairs are shuffled."""
    few = bounded(pairs)

    def side(name: str) -> DataFrame:
        return items.select(F.col("id").alias(name), *(
            F.col(c).alias(f"{c}_{name}") for c in items.columns if c != "id"))

    return side("b").join(few, "b").join(side("a").join(few.select("a"), "a", "left_semi"), "a")


def _verified(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose sets are similar enough, as (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(word_sets(batch.column("text_a"), k, TEXT_BYTES),
                            word_sets(batch.column("text_b"), k, TEXT_BYTES), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both * DEN >= NUM * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id.

    A-Z is lower-cased, words are runs without ASCII white space, a text's set holds its
    distinct runs of `k` words (all of it, if it has fewer; nothing without words). Texts
    link when their sets have a Jaccard similarity of 0.8 or more; component_id is the
    least id that links reach, the row itself included.

    1. Equal sets collapse to one row (128-bit checksum), so a text copied a million times
       is compared once. Half of the checksum is the id of the set, so that a pass over the
       texts knows it and they need not be shuffled.
    2. Light sets, of few shingles, enumerate their subsets of the sizes that an overlap
       with a similar set can have. Heavy sets are entered into inverted lists. The
       boundary is the size at which the postings are fewest, by the counted sizes. The
       keys are taken in PASSES parts, by as many passes over `docs`.
    3. Lists are read by `candidates.similar_links`; candidates that pass the sketches of
       their sets, then their marks, are compared on their whole texts.

    The lists are not kept per shingle but per segment: the shingles that a hash deals to
    one of so many segments that similar sets must agree in one. A passage found in
    thousands of otherwise different texts would make thousands of long lists of single
    shingles, all to be compared; it makes next to no equal segment. The join is exact up
    to 64-bit hashes.

    Null or empty texts have no shingles and link with nothing. Null ids are skipped by
    the minimum (a component of null ids only is null). Rows that repeat an id count as
    rows. Extra columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"),
                       F.xxhash64(text).alias("text_key"))
    sets = materialise(_sets(rows, k), "join-sets")
    classes = sets.filter("n > 0").groupBy("n", "hi", "lo").agg(
        F.min("doc").alias("least"), F.min(F.struct("doc", "text_key")).alias("one"))
    classes = materialise(classes.withColumn("id", F.col("hi")), "join-classes")

    few = classes.filter(F.col("n") <= DEN * MOST_LIGHT).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in few})

    buckets = open_buckets(*(_keys(rows, k, light, turn, PASSES) for turn in range(PASSES)))
    members = buckets.select("id").distinct()
    wanted = materialise(classes.join(members, "id").select(
        "id", F.col("one.doc").alias("d"), F.col("one.text_key").alias("t")), "join-wanted")
    own = (F.col("text_key") == F.col("t")) & F.col("doc").eqNullSafe(F.col("d"))
    texts = materialise(rows.join(bounded(wanted), own).select("id", "text").dropDuplicates(["id"]), "join-texts")

    sketched = materialise(_sketched(texts, k), "join-sketches")

    def verify(pairs: DataFrame) -> DataFrame:
        # long texts are many times their marks, and most pairs of them are ruled out
        near = materialise(_alike(_beside(pairs, sketched.select("id", "size", "marks"))), "join-near")
        return materialise(_verified(_beside(near, texts), k), "join-links")

    roots = similar_links(buckets, sketched, verify)
    discard(buckets, wanted, texts, sketched)
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "n", "hi", "lo", "least", F.coalesce("root", "id").alias("comp"))
    linked = materialise(named, "join-named")
    least = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = materialise(linked.join(least, "comp").select("n", "hi", "lo", "component_id"),
                        "join-components")
    discard(classes, linked)
    empty = sets.filter("n = 0").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                                        F.col("doc").alias("component_id"))
    return sets.filter("n > 0").join(bounded(found), ["n", "hi", "lo"]).select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id").unionAll(empty)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with one document of each component, that with the least id."""
    id_col = options.get("id_col", "doc_id")
    found = similar_documents(docs, **options)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("_id")).distinct()
    keep = bounded(materialise(keep, "join-keep"))
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
