"""Similar pairs among the members of hash buckets, without all pairs of a bucket.

Both near-duplicate operators give each item a number of bucket keys such that similar
items share one. `similar_links` finds links that join all similar items sharing a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrays import mix
from .common import connected, discard, materialise, shortened

#: Rounds with one centre per bucket, at most, before what is left is compared pair by
#: pair. They end earlier when one links less than this part of what the first linked.
CENTRE_ROUNDS = 8
WORTHWHILE = 0.01
#: Pairs to a posting, of items of few keys, that are sooner compared by their sketches in
#: one join than moved through another round with its shuffles; times the rounds so far,
#: as the first ones join most.
PAIRS_LEFT = 64
#: 64-bit words of a sketch. It tells well up to some 100 elements in a word.
SKETCH = 16


def open_buckets(*parts: DataFrame) -> DataFrame:
    """Postings (key, id) of the keys with two ids or more, written to the shared folder. A
    posting may come several times. The parts share no key; they are taken one after the
    other, so that the shuffle files of one are gone before the next ones are written.

    The postings are shuffled and sorted once, and one pass looks at the ids of each key
    beside its postings; only those of shared keys, a small part, go on. Of keys with the
    same members one is kept (compared by number, least member, xor and sum of their hashes).
    """
    found = [materialise(_shared(postings), "shared-keys") for postings in parts]
    shared = reduce(DataFrame.unionAll, found)
    one = (shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.try_sum(F.shiftrightunsigned(F.xxhash64(F.lit(7), "id"), 28)).alias("y"))
        .groupBy("n", "least", "x", "y").agg(F.min("key").alias("key")).select("key"))
    buckets = materialise(shared.join(one, "key", "left_semi"), "buckets")
    discard(*found)
    return buckets


def _shared(postings: DataFrame) -> DataFrame:
    """The distinct postings (key, id) of the keys with two ids or more."""
    own = Window.partitionBy("key")
    dealt = postings.select("key", "id").repartition("key").select(
        "key", "id", F.min("id").over(own).alias("lo"), F.max("id").over(own).alias("hi"))
    return dealt.filter("lo <> hi").select("key", "id").distinct()


def sketches(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SKETCH 64-bit words per set: the parity of the number of its elements in
    each of 64 * SKETCH cells. An element that only one of two sets has flips one cell,
    so the sketches of two sets differ in no more cells than the sets do in elements."""
    n, cells = len(bounds) - 1, 64 * SKETCH
    owner = np.repeat(np.arange(n), np.diff(bounds))
    at = (mix(sets, 77) % np.uint64(cells)).astype(np.int64)
    odd = (np.bincount(owner * cells + at, minlength=n * cells) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, cells), axis=1).view(np.int64)


#: What `sketched` returns of each item.
SKETCH_FIELDS = "id long, size long, " + ", ".join(f"s{i} long" for i in range(SKETCH))


def sketch_batch(ids: pa.Array, sets: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Rows of SKETCH_FIELDS for sets that lie one after the other."""
    words = sketches(sets, bounds)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(bounds), pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in words.T]],
        names=["id", "size", *[f"s{i}" for i in range(SKETCH)]])


def _may_link() -> Column:
    """No pair (size_a, a0, ..., size_b, b0, ...) with a Jaccard similarity of 0.8 or more
    fails this: sets of n and m elements then differ in at most (n + m) / 9, and so do
    their sketches."""
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH)), F.lit(0))
    n, m = F.col("size_a"), F.col("size_b")
    return (4 * F.greatest(n, m) <= 5 * F.least(n, m)) & (9 * differ <= n + m)


def _least_common() -> Column:
    """Whether the row of a pair (key, keys_a, keys_b) is that of the least common key. A
    function of array elements keeps the join out of generated code, which with arrays of
    both sides in it is so long that most of the join ran before it was compiled."""
    return ~F.exists("keys_a", lambda k: (k < F.col("key")) & F.array_contains(F.col("keys_b"), k))


def _named(sketched: DataFrame, side: str) -> DataFrame:
    """Sketches with the names of one side of a pair; the item is called `side`."""
    return sketched.select(*_renamed(side))


def similar_links(postings: DataFrame, sketched: DataFrame,
                  verify: Callable[[DataFrame], DataFrame], few_keys: bool = False) -> DataFrame:
    """Union-find roots (node, root) over the links, by a Jaccard similarity of 0.8, of
    members of a bucket: `postings` (key, id) as `open_buckets` gives them, `sketched` of
    SKETCH_FIELDS, `verify` from pairs (a, b) to the linked ones. With `few_keys`, for
    items of a small, fixed number of keys, a pair leaves the last step in the least of
    its common buckets alone.

    Rounds: one member of each bucket is its centre and is compared with the others, so
    the pairs are as many as the postings. Linked members join, and a bucket whose members
    are all in one component has nothing left to find and leaves the rounds. Between them
    the links are only shortened, so two members may be joined without yet being known to
    be, which costs a comparison; the roots are found at the end and, where items have many
    keys, before the last step.
    When centres link little more, or after CENTRE_ROUNDS, or, of items of few keys, when
    PAIRS_LEFT pairs to a posting and round are left at most, members of different components
    in one bucket are compared pair by pair, by sketches laid beside the postings; only
    pairs whose sketches allow a link leave the join. No link between members of a bucket
    is lost: a pair is skipped only if it is joined already by other links, was compared
    (not looked up for items of few keys, as hardly any pair comes twice), or its sketches
    rule it out.
    """
    edges, tested, last, most = None, None, False, 0
    now = _centred(postings.select("key", "id", F.col("id").alias("comp")), 0)
    for turn in range(CENTRE_ROUNDS + 2):
        last = last or turn >= CENTRE_ROUNDS
        if edges is not None:
            if last and not few_keys:
                edges = connected(edges, "links").toDF("a", "b")
            labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
            named = now.select("key", "id").join(labels, "id", "left").select(
                "key", "id", F.coalesce("least", "id").alias("comp"))
            before, now = now, materialise(_centred(named, turn), "open")
            discard(before)
            if not now.limit(1).count():
                break
            last = last or few_keys and _pairs(now) <= PAIRS_LEFT * turn * now.count()
        if not last:
            pairs = now.filter("comp <> c_comp").select(
                F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct()
            pairs = pairs.join(_named(sketched, "b"), "b").join(_named(sketched, "a"), "a").filter(
                _may_link()).select("a", "b")
        else:
            beside = now.select("key", "id", "comp").join(sketched, "id")
            if few_keys:
                beside = beside.join(now.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")

            def side(name: str) -> DataFrame:
                more = [F.col(c).alias(f"{c}_{name}") for c in ("comp", "keys") if c in beside.columns]
                return beside.select("key", *more, *_renamed(name))

            pairs = side("a").join(side("b"), "key").filter("a < b and comp_a <> comp_b").filter(_may_link())
            if few_keys:
                pairs = pairs.filter(_least_common()).select("a", "b")
            else:
                pairs = pairs.select("a", "b").distinct()
        if tested is not None and not few_keys:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = verify(pairs)
        if last:
            edges = links if edges is None else links.unionAll(edges)
            break
        n = links.count()
        most = most or n
        last = n <= most * WORTHWHILE
        if n or edges is None:
            edges = shortened(links if edges is None else links.unionAll(edges), "links")
    return connected(edges, "links")


def _centred(named: DataFrame, turn: int) -> DataFrame:
    """The postings (key, id, comp) of keys with several components, with the centre of
    the key (c_id, c_comp)."""
    order = F.col("id") if not turn else F.xxhash64(F.lit(turn), F.col("id"))
    left = named.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("id", order).alias("c_id"),
        F.min_by("comp", order).alias("c_comp")).filter("lo <> hi").select("key", "c_id", "c_comp")
    return named.join(left, "key").select("key", "id", "comp", "c_id", "c_comp")


def _pairs(now: DataFrame) -> float:
    """How many pairs of different components the postings hold, key by key."""
    square = F.col("n").cast("double") * F.col("n")
    own = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    every = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum(square).alias("own"))
    return every.agg(F.sum((square - F.col("own")) / 2)).first()[0] or 0.0


def _renamed(side: str) -> list[Column]:
    return [F.col("id").alias(side), F.col("size").alias(f"size_{side}"),
            *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(SKETCH)]]
