"""A trie of conversation prefixes, in balanced parentheses per shard.

The distinct paths (sequences of turns) are sorted and cut into shards. A shard's trie is
a sequence of parentheses in depth-first order, "(" where a node begins and ")" where it
ends, with the least and greatest excess of each block of them in a tree of blocks. What
is asked of a subtree is asked of the span from a "(" to its `find_close`: leaves by rank
of "()", sums by differences of cumulative arrays in the order of "(".

Neighbouring shards share a spine: the prefixes of the first and last path of a shard may
go on in the shards beside it. Their partial counts are merged by a trie of their own,
built the same way from two paths per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise
from .mixing import n_words

#: Parentheses of a block whose least and greatest excess are kept.
BLOCK = 64
#: Nodes of a shard, after which a new one begins. One path is never cut.
SHARD_NODES = 1 << 17
#: Ends of paths that are joined in one step: a bucket of this many conversation numbers.
BUCKET_BITS = 16
KEY = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NONE = np.iinfo(np.int64).max


class Parentheses:
    """Balanced parentheses with a range min-max tree over the excess of their blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        n = -(-len(bits) // block) or 1
        size = 1 << (n - 1).bit_length()
        padded = np.full(size * block, NONE, dtype=np.int64)
        padded[:len(bits)] = self.excess
        low, high = padded.reshape(size, block).min(axis=1), np.where(padded == NONE, -1, padded).reshape(size, block).max(axis=1)
        self.low, self.high = [low], [high]
        while len(low) > 1:
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)
            self.low.append(low)
            self.high.append(high)
        self.opens = np.flatnonzero(bits)
        leaf = bits.astype(bool)
        leaf[:-1] &= ~leaf[1:]
        self.leaf_pairs = np.concatenate([[0], np.cumsum(leaf)])

    def _scan(self, at: np.ndarray, goal: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Look for the goal from `at` to the end of its block; gives the rows without it."""
        at, left = at.copy(), np.ones(len(rows), dtype=bool)
        ends = np.minimum((at // self.block + 1) * self.block, len(self.bits))
        while len(rows):
            inside = at < ends
            hit = inside & (self.excess[np.minimum(at, len(self.bits) - 1)] == goal)
            out[rows[hit]] = at[hit]
            go = inside & ~hit
            missed = rows[~inside]
            left = missed if left.dtype == bool else np.concatenate([left, missed])
            rows, at, goal, ends = rows[go], at[go] + 1, goal[go], ends[go]
        return left if left.dtype != bool else rows

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The place of the ")" that closes each "(": the first after it with one excess
        less. In its block by a scan; else up the tree to the first block to the right
        whose range of excess holds the goal, down to it and by a scan there."""
        out = np.full(len(opens), -1, dtype=np.int64)
        goal = self.excess[opens] - 1
        rows = self._scan(opens + 1, goal, out, np.arange(len(opens)))
        if not len(rows):
            return out
        goal, node = goal[rows], opens[rows] // self.block
        # a "(" that ends its block starts the scan in the next one
        node = np.maximum(node, (opens[rows] + 1) // self.block)
        level = np.zeros(len(rows), dtype=np.int64)
        climbing = np.ones(len(rows), dtype=bool)
        for k in range(len(self.low)):
            # a left child whose right sibling holds the goal ends the climb
            idx = np.flatnonzero(climbing)
            if not len(idx):
                break
            low, high = self.low[k], self.high[k]
            sibling = node[idx] + 1
            inside = (node[idx] % 2 == 0) & (sibling < len(low))
            sib = np.minimum(sibling, len(low) - 1)
            holds = inside & (low[sib] <= goal[idx]) & (goal[idx] <= high[sib])
            node[idx[holds]], level[idx[holds]] = sibling[holds], k
            climbing[idx[holds]] = False
            node[idx[~holds]] //= 2
        for k in range(len(self.low) - 1, 0, -1):
            idx = np.flatnonzero(level == k)
            child = node[idx] * 2
            goes = (self.low[k - 1][child] <= goal[idx]) & (goal[idx] <= self.high[k - 1][child])
            node[idx], level[idx] = np.where(goes, child, child + 1), k - 1
        self._scan(node * self.block, goal, out, rows)
        return out


class Trie:
    """Builds a trie from sorted paths. Per node, in depth-first order: its parent, depth,
    key (of its last turn), words (of its last turn) and what `add` says ends there."""

    def __init__(self):
        self.keys, self.words, self.parent, self.depth = [b""], [0], [-1], [0]
        self.bits = [1]
        self.stack = [0]
        self.last: list[bytes] = []

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: list[bytes], words: list[int]) -> list[int]:
        """Add a path, not less than those before; gives its nodes, root first."""
        same, most = 0, min(len(keys), len(self.last))
        while same < most and keys[same] == self.last[same]:
            same += 1
        self.bits += [0] * (len(self.stack) - 1 - same)
        del self.stack[same + 1:]
        for d in range(same, len(keys)):
            self.keys.append(keys[d])
            self.words.append(words[d])
            self.parent.append(self.stack[-1])
            self.depth.append(d + 1)
            self.bits.append(1)
            self.stack.append(len(self.keys) - 1)
        self.last = keys
        return self.stack

    def closed(self) -> Parentheses:
        return Parentheses(np.array(self.bits + [0] * len(self.stack), dtype=np.uint8))


def _cumulative(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class Subtrees:
    """What is asked of the subtrees of a closed trie: of node k, the "(" number k, they
    are the nodes from k to `stop[k]`."""

    def __init__(self, trie: Trie):
        self.tree = trie.closed()
        self.parent, self.depth = np.array(trie.parent), np.array(trie.depth)
        self.words = np.array(trie.words, dtype=np.int64)
        close = self.tree.find_close(self.tree.opens)
        self.stop = np.arange(len(trie)) + (close - self.tree.opens + 1) // 2
        pairs = self.tree.leaf_pairs
        self.leaves = pairs[close] - pairs[self.tree.opens]
        self.children = np.bincount(self.parent[1:], minlength=len(trie))

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = _cumulative(values)
        return total[self.stop] - total[:-1]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each subtree, from the deepest nodes up."""
        out = values.copy()
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        for level in np.split(order, cuts):
            level = level[self.parent[level] >= 0]
            np.minimum.at(out, self.parent[level], out[level])
        return out


def _path_id(keys: list[bytes]) -> list[bytes]:
    """An id of each prefix of a path, the empty one first."""
    out = [b"\0" * KEY]
    for key in keys:
        out.append(hashlib.sha256(out[-1] + key).digest()[:KEY])
    return out


_NODE = [("conv_id", "long"), ("depth", "int"), ("parent_conv_id", "long"), ("n_convs", "long"),
         ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string"),
         ("turn_key", "binary")]
NODE_SCHEMA = ", ".join(f"{n} {t}" for n, t in _NODE)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_SPINE = [("spine_keys", "array<binary>", pa.list_(pa.binary())), ("spine_words", "array<long>", pa.list_(pa.int64())),
          ("spine_convs", "array<long>", pa.list_(pa.int64())), ("spine_least", "array<long>", pa.list_(pa.int64())),
          ("spine_children", "array<long>", pa.list_(pa.int64())), ("spine_leaves", "array<long>", pa.list_(pa.int64())),
          ("spine_saved", "array<long>", pa.list_(pa.int64())), ("spine_ends", "array<string>", pa.list_(pa.string()))]
#: A row of a shard is a node, or one of the two paths of its spine (with arrays).
SHARD_SCHEMA = ", ".join([NODE_SCHEMA, "parent_spine binary", "task int", "shard int", "side int",
                          *[f"{n} {t}" for n, t, _ in _SPINE]])


def _node_arrays(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of SHARD_SCHEMA with the given columns, the others null."""
    kinds = {**{k: _ARROW[t] for k, t in _NODE}, "parent_spine": pa.binary(), "task": pa.int32(),
             "shard": pa.int32(), "side": pa.int32(), **{k: t for k, _, t in _SPINE}}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()],
        names=list(kinds))


def _shard_rows(trie: Trie, ends: np.ndarray, least: np.ndarray, hashes: dict[int, str],
                spines: list[list[int]], task: int, shard: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard. `spines` are the nodes of its first and of its last path."""
    sub = Subtrees(trie)
    n = len(trie)
    convs, low = sub.sums(ends), sub.least(least)
    spine = np.zeros(n, dtype=bool)
    for path in spines:
        spine[path] = True
    # what spine nodes save, and whether they are leaves, is only known when all is merged
    saved = sub.sums(np.where(spine, 0, (convs - 1) * sub.words))
    leaves = np.where(spine, sub.sums((sub.children == 0) & ~spine), sub.leaves)
    children = np.where(spine, np.bincount(sub.parent[1:], weights=~spine[1:], minlength=n).astype(np.int64), sub.children)
    inner = np.flatnonzero(~spine)
    if len(inner):
        up = sub.parent[inner]
        under = spine[up]
        ids: dict[int, bytes] = {}
        for path in spines:
            ids.update(zip(path, _path_id([trie.keys[k] for k in path[1:]])))
        yield _node_arrays({
            "conv_id": low[inner], "depth": sub.depth[inner],
            "parent_conv_id": pa.array(low[up], mask=under), "n_convs": convs[inner],
            "n_children": children[inner], "n_leaves": leaves[inner], "saved_tokens": saved[inner],
            "ends_sha256": [hashes.get(k, NO_ENDS) for k in inner.tolist()],
            "turn_key": [trie.keys[k] for k in inner.tolist()],
            "parent_spine": [ids[u] if s else None for u, s in zip(up.tolist(), under.tolist())]}, len(inner))
    done: set[int] = set()
    for side, path in enumerate(spines):
        # a node that is on both paths counts once
        own = np.array([k not in done for k in path])
        done.update(path)
        at = np.array(path)
        # direct ends of spine nodes and what hangs below them outside the spine
        below = ends + np.bincount(np.maximum(sub.parent, 0), weights=np.where(spine, 0, convs), minlength=n).astype(np.int64)
        near = least.copy()
        np.minimum.at(near, sub.parent[inner], low[inner])
        inner_sum = lambda v: np.where(own, np.bincount(
            np.maximum(sub.parent, 0), weights=np.where(spine, 0, v), minlength=n).astype(np.int64)[at], 0)
        yield _node_arrays({
            "task": [task], "shard": [shard], "side": [side],
            "spine_keys": [[trie.keys[k] for k in path[1:]]],
            "spine_words": [[trie.words[k] for k in path[1:]]],
            "spine_convs": [np.where(own, below[at], 0).tolist()],
            "spine_least": [np.where(own, near[at], NONE).tolist()],
            "spine_children": [np.where(own, children[at], 0).tolist()],
            "spine_leaves": [inner_sum(leaves).tolist()],
            "spine_saved": [inner_sum(saved).tolist()],
            "spine_ends": [[hashes.get(k) if o else None for k, o in zip(path, own.tolist())]]}, 1)


def _shards(paths: DataFrame, shard_nodes: int) -> DataFrame:
    """Rows of SHARD_SCHEMA from sorted rows (keys, words, n_ends, least, ends_sha256)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, trie = TaskContext.get().partitionId(), 0, None
        ends: dict[int, int] = {}
        least: dict[int, int] = {}
        hashes: dict[int, str] = {}
        first: list[int] = []

        def rows() -> Iterator[pa.RecordBatch]:
            full = lambda d, empty: np.array([d.get(k, empty) for k in range(len(trie))], dtype=np.int64)
            yield from _shard_rows(trie, full(ends, 0), full(least, NONE), hashes,
                                   [first, list(trie.stack)], task, shard)

        for batch in batches:
            for keys, words, n, low, sha in zip(*[batch.column(i) for i in range(5)], strict=True):
                if trie is not None and len(trie) >= shard_nodes:
                    yield from rows()
                    trie, shard = None, shard + 1
                if trie is None:
                    trie = Trie()
                    ends, least, hashes, first = {}, {}, {}, []
                path = trie.add(keys.as_py(), words.as_py())
                first = first or list(path)
                ends[path[-1]], least[path[-1]], hashes[path[-1]] = n.as_py(), low.as_py(), sha.as_py()
        if trie is not None:
            yield from rows()

    return paths.mapInArrow(run, SHARD_SCHEMA)


def _merged_spine(shards: DataFrame) -> DataFrame:
    """The nodes of the spines, with a `spine` id: partial counts of all shards merged by a
    trie of the two paths of each shard, taken in order. Its size is that of the shards'
    borders, not of the data, so one task holds it."""
    names = [n for n, _, _ in _SPINE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, got, hashes = Trie(), {}, {}
        ids = [b"\0" * KEY]
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True):
                keys, words, *counts, ends = row
                before = len(trie)
                path = trie.add(keys, words)
                for k in range(before, len(trie)):
                    ids.append(hashlib.sha256(ids[trie.parent[k]] + trie.keys[k]).digest()[:KEY])
                for k, sha, *values in zip(path, ends, *counts, strict=True):
                    one = got.setdefault(k, [0, NONE, 0, 0, 0])
                    got[k] = [one[0] + values[0], min(one[1], values[1]),
                              *[a + b for a, b in zip(one[2:], values[2:])]]
                    if sha is not None:
                        hashes[k] = sha
        if len(trie) == 1 and not got:
            return
        table = np.array([got[k] for k in range(len(trie))], dtype=np.int64)
        sub = Subtrees(trie)
        convs, low = sub.sums(table[:, 0]), sub.least(table[:, 1])
        # table: children, leaves and savings of what hangs on a spine node outside the spine
        children = sub.children + table[:, 2]
        leaves = sub.sums(table[:, 3] + (children == 0))
        saved = sub.sums(table[:, 4] + (convs - 1) * sub.words)
        for at in range(0, len(trie), 10_000):
            to = min(at + 10_000, len(trie))
            up = sub.parent[at:to]
            kinds = [_ARROW[t] for _, t in _NODE] + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((
                low[at:to], sub.depth[at:to], pa.array(low[np.maximum(up, 0)], mask=up < 0), convs[at:to],
                children[at:to], leaves[at:to], saved[at:to],
                [hashes.get(k, NO_ENDS) for k in range(at, to)], trie.keys[at:to], ids[at:to]), kinds,
                strict=True)], names=[*[n for n, _ in _NODE], "spine"])

    spine = shards.filter("side is not null").repartition(1).sortWithinPartitions("task", "shard", "side")
    return spine.select(*names).mapInArrow(run, NODE_SCHEMA + ", spine binary")


def _joined_ends(paths: DataFrame) -> DataFrame:
    """(path, ends_sha256) from (path, conv_id): SHA-256 of the ascending numbers, comma
    between. Numbers are joined in buckets of 2 ** BUCKET_BITS, of which a path has each
    once, so a path on which a third of all conversations end is a row per bucket; these
    rows are hashed as a sorted stream, as SHA-256 goes through its input in order."""
    parts = paths.groupBy("path", F.shiftright("conv_id", BUCKET_BITS).alias("bucket")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for path, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = path, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])],
                                             names=["path", "ends_sha256"])

    return (parts.repartition("path").sortWithinPartitions("path", "bucket").select("path", "ends")
            .mapInArrow(run, "path string, ends_sha256 string"))


def turns_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation its turns in order (null first), each as `key`, 16
    bytes of a SHA-256 of role and text, and `words`. Texts stay in the scan.

    Null roles and texts count as empty. Turns of equal number lie in the order of their
    keys; repeated rows are turns of their own. Rows with a null conversation belong to
    none and are left out. A conversation is one row of some 40 bytes a turn.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(said, 256), 1, 2 * KEY))
    one = F.struct(F.col(turn_col).alias("turn"), key.alias("key"), n_words(text).alias("words"))
    every = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), one.alias("one"))
    return every.groupBy("conv_id").agg(F.transform(
        F.sort_array(F.collect_list("one")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(convs: DataFrame, base: Column, n_shared: Column) -> DataFrame:
    """`convs` whose first `n_shared` (an int) turns are those of the conversation `base`
    (none if there is no such), followed by their own after the first `n_shared`."""
    heads = convs.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_head"))
    rows = convs.withColumn("_base", base).withColumn("_n", n_shared.cast("int"))
    bases = rows.select("_base").distinct()
    heads = heads.join(bases, "_base", "left_semi")
    empty = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_n")), empty)
    own = F.slice("turns", F.col("_n") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(heads, "_base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def prefix_nodes(convs: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of `convs` (conv_id, turns as `turns_of` gives them, each
    conv_id once): every distinct sequence of the first d turns, the empty one included.

    conv_id: smallest conversation that starts with it; depth: d; parent_conv_id: that of
    its parent (null for the root); n_convs: conversations that start with it; n_children;
    n_leaves: childless nodes in its subtree; saved_tokens: over its subtree, words of the
    last turn times conversations less one; ends_sha256: of the numbers of conversations
    with no further turn; turn_key: key of the last turn (empty for the root).

    1. Conversations with equal turns are combined to one path, by a digest, before paths
       move; the turns of the smallest come back by its number.
    2. Paths are sorted by range partitions, so a first turn that a third of all
       conversations share is spread by what follows it; each task encodes shards.
    3. Nodes within a shard are final. Prefixes of a shard's first and last path are
       partial; `_merged_spine` merges them, and nodes whose parent is one ask it.

    Conversations without turns are members of the root alone. No conversation: no node.
    """
    flat = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    rows = materialise(convs.select("conv_id", "turns", F.sha2(flat, 256).alias("path")), "trie-paths")
    kinds = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_ends"), F.min("conv_id").alias("least"))
    ends = _joined_ends(rows.select("path", "conv_id"))
    paths = (rows.select(F.col("conv_id").alias("least"), "turns").join(kinds, "least").join(ends, "path")
             .select(F.transform("turns", lambda t: t["key"]).alias("keys"),
                     F.transform("turns", lambda t: t["words"]).alias("words"), "n_ends", "least", "ends_sha256"))
    paths = materialise(paths, "trie-distinct")
    sorted_ = paths.repartitionByRange("keys").sortWithinPartitions("keys")
    shards = materialise(_shards(sorted_, shard_nodes), "trie-shards")
    spine = materialise(_merged_spine(shards), "trie-spine")
    names = [n for n, _ in _NODE]
    parents = spine.select(F.col("spine").alias("parent_spine"), F.col("conv_id").alias("_up"))
    inner = shards.filter("side is null").select(*names, "parent_spine").join(parents, "parent_spine", "left")
    up = F.coalesce("parent_conv_id", "_up").alias("parent_conv_id")
    return inner.select(*[up if n == "parent_conv_id" else F.col(n) for n in names]).unionAll(spine.select(*names))
