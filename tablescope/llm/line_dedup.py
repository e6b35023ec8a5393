"""Fuzzy line dedup: MinHash over character shingles, banding, exact check, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrays import mix
from .candidates import SKETCH_FIELDS, open_buckets, similar_links, sketch_batch
from .common import bounded, discard, materialise

#: Characters of a shingle. At 9, unrelated lines of a language share next to none.
SHINGLE = 9
#: Similarity as a fraction of the union, and bands of rows of the signature. At the
#: threshold a pair shares a band with probability 1 - (1 - 0.8 ** 5) ** 12 = 0.99.
NUM, DEN = 4, 5
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
#: Characters of lines that a task holds at a time, and places whose runs are hashed at a
#: time: arrays of that size stay in a core's cache, however long a line is.
BLOCK_CHARS = 1 << 18
WINDOW = 1 << 14
EMPTY = np.uint32(0xFFFFFFFF)
BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]
#: Lines that a task remembers so as not to hash their shingles again.
SEEN_LINES = 1 << 17
# What Spark's xxhash64 starts from, for one column and for a 7 before it.
SEED_A, SEED_B = 42, 15582532517514291953
#: White space as Python's isspace knows it, for a character class.
SPACE = (r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    """The distinct runs of `k` characters; the line itself if it is shorter."""
    return {line[i:i + k] for i in range(max(1, len(line) - k + 1))}


def _run_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k characters from each place on, by doubling the span."""
    base = 0x5851F42D4C957F2D
    spans = {1: chars.astype(np.uint64)}
    spans[1] += np.uint64(1)
    done, out, width = 0, None, 1
    while 2 * width <= k:
        half = spans[width]
        span = half[:-width] * np.uint64(pow(base, width, 1 << 64))
        span += half[width:]
        width *= 2
        spans[width] = span
    for width, h in sorted(spans.items(), reverse=True):
        if k & width:
            if out is None:
                out = h
            else:
                n = len(chars) - done - width + 1
                out = out[:n]
                out *= np.uint64(pow(base, width, 1 << 64))
                out += h[done:done + n]
            done += width
    return mix(out)


def _flat_hashes(lines: list[str], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, hashes of the k characters from each place on), WINDOW places at a
    time, of the lines one after the other, with k - 1 line feeds behind each."""
    flat = ("\n" * (k - 1)).join([*lines, ""]) + "\n"
    for at in range(0, len(flat) - k + 1, WINDOW):
        part = flat[at:at + WINDOW + k - 1].encode("utf-32-le", "surrogatepass")
        yield at, _run_hashes(np.frombuffer(part, dtype=np.uint32), k)


def _run_counts(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of each line, repeats included, and the places from it to the next line. A
    short line has one run, which reaches into the padding."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    return np.maximum(1, sizes - k + 1), sizes + k - 1


def _line_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted hashes of the distinct runs of each line."""
    n, steps = _run_counts(lines, SHINGLE)
    h = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in _flat_hashes(lines, SHINGLE))])
    starts = np.cumsum(steps) - steps
    sets = []
    for start, end in zip(starts.tolist(), (starts + n).tolist()):  # many short sorts are faster than one by two keys
        one = np.sort(h[start:end])
        new = np.ones(len(one), dtype=bool)
        np.not_equal(one[1:], one[:-1], out=new[1:])
        sets.append(one[new])
    return sets


def _minima(lines: list[str], k: int) -> np.ndarray:
    """The least hash of the runs of each line in each bin, EMPTY for bins without any."""
    n, steps = _run_counts(lines, k)
    nowhere = len(lines) * BINS  # for places whose k characters reach behind their line
    bounds = np.cumsum(np.stack([n, steps - n], axis=1).ravel())
    bounds[-1:] += 1
    first = np.full(2 * len(lines), nowhere)
    first[::2] = np.arange(len(lines)) * BINS
    out = np.full(nowhere + BINS, EMPTY, dtype=np.uint32)
    for start, h in _flat_hashes(lines, k):
        end = start + len(h)
        low, high = np.searchsorted(bounds, start, "right"), np.searchsorted(bounds, end, "left") + 1
        at = h >> np.uint64(32)
        at *= np.uint64(BINS)
        at >>= np.uint64(32)
        at = at.view(np.int64)
        at += np.repeat(first[low:high], np.diff(np.clip(bounds[low:high], start, end), prepend=start))
        np.minimum.at(out, at, h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    return out[:nowhere]


def signatures(lines: list[str], k: int = SHINGLE) -> np.ndarray:
    """A row of BINS values per line: one-permutation MinHash, empty bins filled from
    full ones picked by hash (Shrivastava, "Optimal Densification")."""
    out = _minima(lines, k)
    full = out != EMPTY
    bad = np.flatnonzero(~full)
    for turn in range(64):
        if not len(bad):
            break
        pick = (mix((bad % BINS).astype(np.uint64), 100 + turn) % np.uint64(BINS)).astype(np.int64)
        pick += bad // BINS * BINS
        good = full[pick]
        out[bad[good]] = out[pick[good]]
        bad = bad[~good]
    out, full = out.reshape(len(lines), BINS), full.reshape(len(lines), BINS)
    if len(bad):  # as good as never: take the first full bin
        out.ravel()[bad] = out[bad // BINS, full.argmax(axis=1)[bad // BINS]]
    return out


def bands(lines: list[str]) -> np.ndarray:
    """BANDS bucket keys per line."""
    sig = signatures(lines).astype(np.uint64).reshape(len(lines), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(lines), BANDS)).copy()
    for j in range(ROWS):
        h = mix(h ^ sig[:, :, j], j)
    return h


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def line_keys(line) -> tuple:
    """The two 64-bit hashes of a line that stand for it, as `_lines` computes them."""
    return F.xxhash64(line).alias("ka"), F.xxhash64(F.lit(7).cast("long"), line).alias("kb")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, text_key, pos, ka, kb, b0, b1, ...) of each line that is not blank. Bands are
    given the first time that a task meets a line, else null."""
    names = ["doc", "text_key", "pos", "ka", "kb", *BAND_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            docs_, keys, texts = batch.column("doc"), batch.column("text_key"), batch.column("text")
            held, owner, pos, chars = [], [], [], 0
            for i, text in enumerate(texts):
                for j, line in enumerate(text.as_py().split("\n")):
                    if line and not line.isspace():
                        held.append(line)
                        owner.append(i)
                        pos.append(j)
                        chars += len(line)
                    if chars >= BLOCK_CHARS:
                        yield rows(docs_, keys, held, owner, pos, seen)
                        held, owner, pos, chars = [], [], [], 0
            if held:
                yield rows(docs_, keys, held, owner, pos, seen)

    def rows(docs_, keys, held, owner, pos, seen) -> pa.RecordBatch:
        owner, raw = pa.array(owner), [x.encode() for x in held]
        ka = [xxhash.xxh64_intdigest(x, SEED_A) for x in raw]
        kb = [xxhash.xxh64_intdigest(x, SEED_B) for x in raw]
        fresh = []
        for i, key in enumerate(zip(ka, kb)):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        if len(seen) > SEEN_LINES:
            seen.clear()
        # the number of the fresh line that a row is, null for the others
        nth = np.full(len(held), -1)
        nth[fresh] = np.arange(len(fresh))
        nth = pa.array(nth, mask=nth < 0)
        found = bands([held[i] for i in fresh]).view(np.int64) if fresh else np.zeros((0, BANDS), np.int64)
        return pa.RecordBatch.from_arrays(
            [docs_.take(owner), keys.take(owner), pa.array(pos, pa.int32()), _signed(ka), _signed(kb),
             *[pa.array(np.ascontiguousarray(c)).take(nth) for c in found.T]], names=names)

    return docs.select("doc", "text_key", "text").mapInArrow(
        run, f"doc {docs.schema['doc'].dataType.simpleString()}, text_key long, pos int, ka long, kb long, "
             + ", ".join(f"{c} long" for c in BAND_COLUMNS))


def _sketched(texts: DataFrame) -> DataFrame:
    """Sketches of lines (id, line), by hashes of their distinct runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = _line_sets(part.column("line").to_pylist())
                yield sketch_batch(part.column("id"), np.concatenate(sets), np.cumsum([0, *map(len, sets)]))

    return texts.select("id", "line").mapInArrow(run, SKETCH_FIELDS)


def similar(left: list[str], right: list[str]) -> list[bool]:
    """Whether the lines of each pair have similar enough sets of runs, compared by the
    64-bit hashes of all their runs."""
    kept = []
    for x, y in zip(_line_sets(left), _line_sets(right), strict=True):
        every = np.sort(np.concatenate([x, y]))
        both = int(np.count_nonzero(every[1:] == every[:-1]))
        kept.append(both * DEN >= NUM * (len(every) - both))
    return kept


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                kept = similar(part.column("text_a").to_pylist(), part.column("text_b").to_pylist())
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` and n_lines, n_removed (long); of all similar lines
    of the corpus the text of one document keeps one.

    Lines are what line feeds separate. Two lines are similar if the Jaccard similarity
    of their sets of 9-character runs is 0.8 or more (a shorter line is its own run); the
    components of that relation keep one line, that of the least id, then of the first
    place. Blank lines count for nothing and stay. Equal lines always meet; of unequal
    ones at the threshold, 99 % share a band, more above it; what shares a band is compared
    on the lines themselves.

    1. Each task emits per line two hashes and, once per line, the band keys; text stays
       where it is.
    2. Equal lines are combined before they are shuffled, so a line that a third of all
       documents hold is one row per task.
    3. `candidates.similar_links` compares members of a bucket with a centre, then only
       what no centre linked. Lines are compared by 64-bit hashes of all their runs.
    4. Of the lines that occur more than once, alone or by their component, the places to
       remove join the documents, by id and a hash of the text.

    n_lines counts lines with a character that is no white space (Unicode's).
    A null text stays null and has no lines. Rows that repeat id and text are one
    document: they keep the same lines. Null ids come first. Extra columns pass through,
    unless they are named n_lines or n_removed, which are replaced. An empty table gives
    an empty result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    lines = materialise(_lines(rows), "lines")
    kinds = lines.groupBy("ka", "kb").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in BAND_COLUMNS])
    kinds = materialise(kinds.withColumn("id", F.monotonically_increasing_id()), "line-kinds")

    buckets = open_buckets(kinds.select("id", F.explode(F.array(*BAND_COLUMNS)).alias("key")))
    members = buckets.select("id").distinct()
    wanted = materialise(kinds.join(members, "id").select("id", "ka", "kb"), "line-wanted")
    line = F.col("line")
    every = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).select("line", *line_keys(line))
    texts = materialise(every.join(bounded(wanted), ["ka", "kb"]).groupBy("id").agg(
        F.first("line").alias("line")), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("text_a"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("text_b"))
        return materialise(_verified(pairs.join(b, "b").join(a, "a")), "line-links")

    sketched = materialise(_sketched(texts), "line-sketches")
    roots = similar_links(buckets, sketched, verify, few_keys=True)
    discard(buckets, wanted, texts, sketched)
    # a kind alone in its component matters only if it has several places itself
    linked = kinds.select("id", "ka", "kb", "n").join(
        roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id"))
    roots_ = roots.select(F.col("root").alias("id"), F.lit(True).alias("leads")).distinct()
    found = materialise(linked.join(roots_, "id", "left").filter("n > 1 OR root IS NOT NULL OR leads").select(
        "ka", "kb", "comp"), "line-found")
    discard(kinds)
    places = materialise(lines.select("doc", "text_key", "pos", "ka", "kb").join(
        bounded(found), ["ka", "kb"]).select("comp", "doc", "text_key", "pos"), "line-occurrences")
    discard(lines, found)
    first = materialise(places.groupBy("comp").agg(
        F.min(F.struct("doc", "text_key", "pos")).alias("keep")), "line-kept")
    removed = places.join(bounded(first), "comp").filter(
        ~F.struct("doc", "text_key", "pos").eqNullSafe(F.col("keep")))
    every, places = places, materialise(removed.groupBy("doc", "text_key").agg(
        F.collect_set("pos").alias("places")), "line-places")
    discard(every, first)

    x = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    places = places.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"),
                           F.col("places").alias("_places"))
    split = F.split(F.col(text_col), "\n")
    kept = F.filter(split, lambda line, i: ~F.array_contains(F.col("_places"), i))
    n_lines = F.coalesce(F.array_size(F.filter(split, lambda line: line.rlike(f"[^{SPACE}]"))), F.lit(0))
    joined = docs.join(places, F.col(id_col).eqNullSafe(F.col("_doc")) & (x == F.col("_key")), "left")
    out = [F.when(F.col("_places").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
           .alias(c) if c == text_col else F.col(c) for c in own]
    return joined.select(
        *out, n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed"))
