"""The prefix trie against a dictionary of prefixes, its parentheses against a stack."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import prefix_trie, queries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def count(text):
    return len("".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ")) - sum(
        x == "" for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" "))


def by_prefixes(rebuilt):
    """Nodes of {conv_id: [(role, text), ...]} by a dictionary of all prefixes."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[:d - 1])].add(tuple(path[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * count(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    ends = {n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(rebuilt[c]) == len(n)))).encode())
            for n in members}
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]),
                   leaves[n], saved[n], ends[n].hexdigest()) for n in members)


def rebuilt_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_close_is_found_as_by_a_stack():
    rng = random.Random(1)
    for n in (1, 2, 31, 32, 33, 200, 3000):
        for lean in (0.2, 0.5, 0.9):
            bits, depth = [1], 1
            while len(bits) < 2 * n and depth:
                up = rng.random() < lean and len(bits) + depth < 2 * n
                bits.append(int(up or depth == 1 and len(bits) + depth < 2 * n))
                depth += 1 if bits[-1] else -1
            stack, expected = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    expected[stack.pop()] = i
            for block in (4, 64):
                tree = prefix_trie.Parentheses(np.array(bits, dtype=np.uint8), block)
                assert dict(zip(tree.opens.tolist(), tree.find_close(tree.opens).tolist())) == expected


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_prefixes(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op12_prefix_trie"](spark, sf_dir)
    assert found.columns == list(COLUMNS)
    assert nodes(found) == by_prefixes(rebuilt_of(rows))


@pytest.mark.parametrize("shard_nodes", [1, 7, 1 << 17])
def test_shared_spines_merge(spark, shard_nodes):
    rng = random.Random(shard_nodes)
    rows = []
    for c in range(300):
        path = [] if c % 50 == 7 else ["hello there"] * (c % 3) + [rng.choice(["a", "b b", "c c c"]) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, "user", t) for i, t in enumerate(path)] or [(c, 0, None, None)]
    rows += [(1000 + i, j, "user", t) for i in range(150) for j, t in enumerate(["same", "copy of all"])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = {}
    for c, i, role, text in rows:
        expected.setdefault(c, []).append((role or "", text or ""))
    found = prefix_trie.prefix_nodes(prefix_trie.turns_of(df), shard_nodes=shard_nodes)
    assert nodes(found) == by_prefixes(expected)


def test_odd_turns(spark):
    long = "many words " * 20_000
    rows = [(0, None, None, None), (0, 1, "user", long), (0, 2, "a", "x"), (3, None, "r", "t"), (3, 5, "", ""),
            (20, 0, "user", "Ü  é\t\nz"), (21, 0, "user", None), (None, 0, "user", "lost"), (5, 0, "u", "v"),
            (25, 1, "u", "v"), (25, 0, "u", "v"), (25, 2, "u", "v"), (25, 3, "u", "v")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("path", F.lit(2)).withColumn("key", F.lit(3))
    c = F.col("conv_id")
    heads = prefix_trie.with_shared_heads(prefix_trie.turns_of(df), c - c % 20, F.crc32(c.cast("string")) % 4)
    assert nodes(prefix_trie.prefix_nodes(heads)) == by_prefixes(rebuilt_of(rows))
    repeated = spark.createDataFrame([(1, 0, "u", "same")] * 3 + [(2, 0, "u", "same")], SCHEMA)
    found = nodes(prefix_trie.prefix_nodes(prefix_trie.turns_of(repeated)))
    assert [(r[0], r[1], r[3], r[6]) for r in found] == [(1, 0, 2, 1), (1, 1, 2, 1), (1, 2, 1, 0), (1, 3, 1, 0)]
    assert prefix_trie.prefix_nodes(prefix_trie.turns_of(df.limit(0))).count() == 0
