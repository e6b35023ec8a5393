"""Operators on texts: brute force on small fixtures, defined results in odd cases."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare
from tablescope.llm import (arrays, candidates, common, exact_dedup, jaccard_join, language, line_dedup, mixing, packing,
                            quality, queries, tokens)
from tablescope.session import shared_dir

SF = "/root/testdata/sf0.001"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def word_shingles(text, k=5):
    w = words(text)
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(sets):
    """Least index that links reach, by comparing all pairs that share an element."""
    holds, parent = defaultdict(list), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        shared = Counter(j for e in one for j in holds[e])
        for j, both in shared.items():
            if 5 * both >= 4 * (len(one) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for e in one:
            holds[e].append(i)
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert compare.difference(found, compare.connect(SF), queries.ORACLES[name]) is None


# --- hashing ---------------------------------------------------------------------------

def test_word_sets_count_as_by_hand():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab ", "CD", "é\n", "\t", "f", "  "]) for _ in range(rng.randint(0, 60)))
             for _ in range(300)] + [None, ""]
    assert [len(x) for x in arrays.word_sets(pa.array(texts), 5)] == [len(word_shingles(t)) for t in texts]


@pytest.mark.parametrize("light", [4, 9, 14])
def test_similar_sets_share_a_key(light):
    rng = random.Random(light)
    for n in [*range(1, 40), 64, 100, 127, 128, 160, 300]:
        for m in rng.sample(list(jaccard_join.partners(n)), min(3, len(jaccard_join.partners(n)))):
            both = jaccard_join.overlap(n, m)
            if both > min(n, m) or n == m == both:
                continue
            a = [rng.getrandbits(63) for _ in range(n)]
            b = rng.sample(a, both) + [rng.getrandbits(63) for _ in range(m - both)]
            row, key = jaccard_join.keys_of(np.array(sorted(a) + sorted(b), np.uint64),
                                            np.array([0, n, n + m]), light)
            assert set(key[row == 0]) & set(key[row == 1]), (n, m)


def test_line_bands_have_high_recall():
    rng = random.Random(5)
    met = total = 0
    for _ in range(400):
        line = "".join(rng.choice("abcdefghij  ") for _ in range(rng.randint(30, 300)))
        other = list(line)
        for _ in range(max(1, len(line) // 90)):
            other[rng.randrange(len(other))] = "z"
        a, b = line_dedup.shingles(line), line_dedup.shingles("".join(other))
        if len(a & b) >= 0.8 * len(a | b):
            x, y = line_dedup.bands([line, "".join(other)])
            total, met = total + 1, met + bool((x == y).any())
    assert total > 100 and met >= 0.98 * total


def test_long_lines_are_hashed_in_little_memory():
    """The arrays of a line stay small however long it is (round 3: executor memory)."""
    line = "".join(map(str, range(300_000)))
    tracemalloc.start()
    line_dedup.bands([line, "a short one"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(line) > 1_600_000 and most < 8 * len(line)


def test_windows_change_no_hash(monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abü\U0001F600 ") for _ in range(rng.choice([1, 8, 9, 10, 40, 200]))) for _ in range(60)]
    whole, sets = line_dedup.bands(lines), line_dedup._line_sets(lines)
    assert [len(x) for x in sets] == [len(line_dedup.shingles(x)) for x in lines]
    for window in (1, 5, 64):
        monkeypatch.setattr(line_dedup, "WINDOW", window)
        assert (line_dedup.bands(lines) == whole).all()
        assert all((x == y).all() for x, y in zip(line_dedup._line_sets(lines), sets, strict=True))


def test_pairs_leave_in_their_least_common_bucket(spark):
    rng = random.Random(4)
    keys = {i: rng.sample(range(-9, 9), rng.randint(1, 6)) for i in range(30)}
    rows = [(key, a, b, keys[a], keys[b]) for a in keys for b in keys if a < b for key in {*keys[a]} & {*keys[b]}]
    df = spark.createDataFrame(rows, "key long, a long, b long, keys_a array<long>, keys_b array<long>")
    found = sorted(tuple(r) for r in df.filter(candidates._least_common()).select("key", "a", "b").collect())
    assert found == sorted({(min({*keys[a]} & {*keys[b]}), a, b) for _, a, b, _, _ in rows})


# --- line dedup ------------------------------------------------------------------------

def by_lines(rows):
    """Kept texts of (id, text) rows by comparing all lines."""
    places = defaultdict(list)
    for key, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line and not line.isspace():
                places[line].append((key, pos))
    lines = sorted(places, key=lambda x: min(places[x]))
    groups = defaultdict(list)
    for line, root in zip(lines, components([line_dedup.shingles(x) for x in lines])):
        groups[root] += places[line]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {k: t if t is None else "\n".join(
        x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}


def test_line_keys_agree_with_spark(spark):
    texts = ["", "a", "é\r", "x" * 70, " 1 2"]
    df = spark.createDataFrame([(t,) for t in texts], "line string").select("line", *line_dedup.line_keys(F.col("line")))
    for r in df.collect():
        raw = r["line"].encode()
        assert [r["ka"] & (1 << 64) - 1, r["kb"] & (1 << 64) - 1] == [
            line_dedup.xxhash.xxh64_intdigest(raw, line_dedup.SEED_A), line_dedup.xxhash.xxh64_intdigest(raw, line_dedup.SEED_B)]


def test_pairs_of_lines_are_compared_as_sets():
    rng = random.Random(9)
    left, right = [], []
    for _ in range(600):
        line = "".join(rng.choice("abcü ") for _ in range(rng.randint(1, 120)))
        other = list(line)
        for _ in range(rng.randint(0, 2)):
            other[rng.randrange(len(other))] = "z"
        left.append(line)
        right.append("".join(other))
    exact = []
    for a, b in zip(left, right):
        a, b = line_dedup.shingles(a), line_dedup.shingles(b)
        exact.append(5 * len(a & b) >= 4 * len(a | b))
    assert line_dedup.similar(left, right) == exact and 100 < sum(exact) < 500


def test_lines_of_any_white_space(spark):
    """Blank lines are judged alike by the count and by the removal."""
    blank = ["\r", "\t\r", "\u3000", "\x85\x1f", " "]
    one = "\r\n".join(["A line of some words.", "", "Another line, too."]) + "\r\n" + "\n".join(blank)
    df = spark.createDataFrame([(1, one), (2, one), (3, "\r\n"), (4, "\n".join(blank))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [(found[i]["n_lines"], found[i]["n_removed"]) for i in (1, 2, 3, 4)] == [(2, 0), (2, 2), (0, 0), (0, 0)]
    kept = corpus_pipeline.dedup_lines(spark, df, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_line_dedup_matches_brute_force(documents):
    expected = by_lines([tuple(r) for r in documents.select("doc_id", "text").collect()])
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents).collect()}
    assert found == expected


def test_components_of_repeated_edges(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    pairs += [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    pairs += [(3050, 3000 + i) for i in range(50)] + [(7, 7)] + pairs[:40] + [(b, a) for a, b in pairs[20:60]]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = [tuple(r) for r in common.connected(spark.createDataFrame(pairs, "a long, b long"), "test").collect()]
    assert len(found) == len(dict(found))
    assert dict(found) == {x: r for x, r in root.items() if x != r}
    assert common.connected(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_line_links_take_few_rounds(spark, monkeypatch):
    """Where few pairs are left after the first centres, they are compared at once, and
    star rounds end with the stars."""
    base = "This line of text is one of many that are nearly the same as others, number"
    lines = [f"{base} {i} and {j}" for i in range(6) for j in range(6)] + [f"{i} other {i * 7919} {i * 31}" for i in range(20)]
    written = []
    for module in (common, candidates, line_dedup):
        monkeypatch.setattr(module, "materialise", lambda df, label, write=module.materialise: (
            written.append(label), write(df, label))[1])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert found == by_lines(list(enumerate(lines)))
    assert written.count("pairs") <= 2 and written.count("links") <= 5


def test_line_dedup_odd_rows(odd, nothing):
    found = line_dedup.dedup_lines(odd).collect()
    assert len(found) == 14
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[3]["text"] is None and by_id[3]["n_lines"] == 0
    assert by_id[4]["text"] == "" and by_id[5]["text"] == " \n\t "
    assert by_id[1]["n_removed"] == 0 and by_id[9]["n_removed"] == 1
    assert (by_id[7]["n_removed"], by_id[12]["n_removed"]) == (0, 1)
    assert by_id[1]["kept"] == "extra"
    assert line_dedup.dedup_lines(nothing).count() == 0


# --- Jaccard join ----------------------------------------------------------------------

def test_jaccard_join_matches_brute_force(spark, documents):
    rng = random.Random(9)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    for i in range(60):  # small sets and chains near the threshold
        base = [f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 40))]
        for _ in range(3):
            rows.append((10_000 + len(rows), " ".join(base)))
            base = list(base)
            base[rng.randrange(len(base))] = f"v{rng.randrange(99)}"
    rows.sort()
    sets = [word_shingles(t) for _, t in rows]
    roots = components(sets)
    expected = {k: (len(s), rows[r][0]) for (k, _), s, r in zip(rows, sets, roots)}
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == expected


def test_jaccard_join_odd_rows(odd, nothing):
    found = [tuple(r) for r in jaccard_join.similar_documents(odd).collect()]
    assert len(found) == 14
    by_id = dict((r[0], r[1:]) for r in found)
    assert by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (0, 5)
    assert by_id[2][1] == 1 and by_id[9][1] == 8 and by_id[12] == (1, 7)
    assert by_id[11] == (37, 10) and by_id[None][1] is None
    assert jaccard_join.similar_documents(nothing).count() == 0


def left_behind(spark, run):
    """Labels of the folders that a call leaves in the shared folder, and what it returns."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*-*"))
    found = run()
    return Counter(re.sub("-[0-9a-f]{32}$", "", p.name) for p in set(folder.glob("*-*")) - before), found


def shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for top in local for p in Path(str(top)).rglob("shuffle_*")}


def test_written_rows_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = common.materialise(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    for _ in range(50):  # they are removed beside what goes on
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and made.count() == 7
    assert spark.conf.get(common.DROP_SHUFFLES, None) is None


def test_discard_deletes_what_was_written_alone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own = spark.read.parquet(str(tmp_path / "own"))
    labels, made = left_behind(spark, lambda: common.materialise(own, "rows"))
    assert labels == {"rows": 1} and made.count() == 3
    folder = Path(made.inputFiles()[0].removeprefix("file:")).parent
    common.discard(own, made, made)
    assert not folder.exists() and own.count() == 3


def test_jaccard_join_shuffles_keys_in_parts_and_no_texts(spark, documents, monkeypatch):
    given = []
    monkeypatch.setattr(jaccard_join, "bounded", lambda df: df)  # as if no side could be broadcast
    monkeypatch.setattr(jaccard_join, "open_buckets", lambda *parts: given.extend(parts) or candidates.open_buckets(*parts))
    jaccard_join.similar_documents(documents.limit(200))
    held = [{tuple(r) for r in part.select("key", "id").collect()} for part in given]
    assert len(held) == jaccard_join.PASSES > 1
    assert all("mapinarrow" in (plan := part._jdf.queryExecution().optimizedPlan().toString().lower())
               and "join" not in plan for part in given)
    whole = {tuple(r) for r in jaccard_join._keys(documents.limit(200), 5, jaccard_join.boundary(Counter(
        n for n in (len(word_shingles(r["text"])) for r in documents.limit(200).collect())
        if 0 < n <= jaccard_join.DEN * jaccard_join.MOST_LIGHT))).select("key", "id").collect()}
    assert sum(map(len, held)) == len(whole) and set.union(*held) == whole
    assert max(map(len, held)) < len(whole) / 2


def test_a_set_gives_its_keys_once_a_task(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    few = jaccard_join._keys(docs.coalesce(1), 5, 4)
    assert few.count() == few.distinct().count() > 0
    twice = jaccard_join._keys(docs.repartition(2), 5, 4)
    assert twice.count() == 2 * few.count()
    found = jaccard_join.similar_documents(docs.repartition(4)).collect()
    assert [r["component_id"] for r in found] == [0] * 40


def test_repeated_postings_share_no_bucket(spark):
    rows = [(1, 5), (1, 5), (2, 5), (2, 6), (2, 6), (3, 7), (3, 8), (3, 7)]
    parts = [spark.createDataFrame([r for r in rows if r[0] % 2 == odd], "key long, id long").repartition(3)
             for odd in (0, 1)]
    labels, found = left_behind(spark, lambda: candidates.open_buckets(*parts))
    assert sorted(tuple(r) for r in found.collect()) == [(2, 5), (2, 6), (3, 7), (3, 8)]
    assert labels == {"buckets": 1}


def test_marks_rule_out_no_similar_sets_but_long_unlike_ones():
    rng = np.random.default_rng(5)
    for n, m, both in ((5000, 4100, 4100), (9000, 9000, 8000), (4090, 4100, 3650), (30, 27, 26), (3, 3, 3)):
        every = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        x, y = every[:n], every[n - both:]
        assert 5 * both >= 4 * (n + m - both)
        found = jaccard_join.marks_differ(jaccard_join.marks(x), jaccard_join.marks(y))
        assert found == jaccard_join.marks_differ(jaccard_join.marks(y), jaccard_join.marks(x))
        assert found <= n + m - 2 * both and 9 * found <= n + m
    every = rng.integers(0, 1 << 63, 13_000, dtype=np.uint64)
    x, y = every[:10_000], every[3000:]  # similarity 0.54
    assert 9 * jaccard_join.marks_differ(jaccard_join.marks(x), jaccard_join.marks(y)) > 20_000


def test_few_texts_of_long_unlike_sets_are_compared(spark, monkeypatch):
    held, real = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, k: held.append(pairs.count()) or real(pairs, k))
    words_ = [f"w{i}" for i in range(10_000)]
    rows = [(i, " ".join(words_ + [f"v{i}x{j}" for j in range(4_000)])) for i in range(8)]  # similarity 0.56
    rows += [(9, rows[2][1] + " and more")]
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i for i in range(8)} | {9: 2}
    assert sum(held) <= 2


def test_jaccard_join_keeps_no_texts(spark, documents):
    labels, found = left_behind(spark, lambda: jaccard_join.similar_documents(documents))
    assert not labels.keys() & {"join-texts", "join-sketches", "join-classes", "shared-keys", "buckets"}
    assert labels["open"] <= 1 and found.count() == documents.count()


def test_line_dedup_leaves_little_to_the_next_stage(spark, documents):
    labels, found = left_behind(spark, lambda: line_dedup.dedup_lines(documents))
    assert labels["line-places"] == 1 and not any(
        x.startswith("line-") and x not in ("line-places", "line-links") for x in labels)
    assert not labels.keys() & {"lines", "shared-keys", "buckets"} and found.count() == documents.count()


# --- exact dedup, mixing ---------------------------------------------------------------

def test_exact_dedup_odd_rows(odd, nothing):
    by_id = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd).collect()}
    assert by_id[1]["keep_id"] == 2 and not by_id[1]["kept"] and by_id[2]["kept"]
    assert by_id[3]["keep_id"] == 4 and by_id[3]["group_size"] == 2
    assert by_id[8]["keep_id"] == 9 and by_id[9]["group_size"] == 3
    assert by_id[None]["kept"] and by_id[None]["keep_id"] is None
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_dedup_looks_past_the_prefix(spark):
    same = "x" * 5000
    df = spark.createDataFrame([(1, same + "a"), (2, same + "b"), (3, same + "A")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(df).collect()} == {1: 3, 2: 2, 3: 3}


def test_mix_odd_rows(odd, nothing):
    found = mixing.mix(odd).collect()
    assert len(found) == 14
    total = sum(len(words(r["text"])) for r in odd.collect())
    assert sum(r["taken"] for r in found) == pytest.approx(total, abs=14)
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert {r["doc_id"]: r["size"] for r in found}[3] == 0
    assert mixing.mix(nothing).count() == 0


def test_repeated_takes_what_mix_plans(documents):
    planned = {r["doc_id"]: r["taken"] for r in mixing.mix(documents).collect() if r["taken"]}
    taken = Counter()
    for r in mixing.repeated(documents).collect():
        taken[r["doc_id"]] += len(words(r["text"]))
    assert taken == planned


# --- language, quality -----------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    found = queries.op4_language(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language_finds_a_mixture(spark, documents):
    model = language.learn(documents)
    one = {r["lang"]: r["text"] for r in documents.filter("length(text) between 900 and 4000").collect()}
    both = spark.createDataFrame([(one["en"][:800] + " " + one["de"][:500],)], "text string")
    found = language.identify(both, model).first()
    assert found["lang_set"] == ["en", "de"] and 0.5 < found["score"] < 0.75


def test_language_finds_small_shares_of_long_texts():
    rng = np.random.default_rng(8)
    probs = rng.dirichlet(np.full(3000, 0.05), 4).astype(np.float64) + 1e-6
    probs /= probs.sum(axis=1, keepdims=True)
    n = [118_200, 0, 1_800, 0]
    grams = np.concatenate([rng.choice(3000, size, p=p) for size, p in zip(n, probs)])
    shares, size = language.infer(np.log(probs).astype(np.float32), grams, np.array([0, len(grams)]))
    assert size.tolist() == [2] and np.flatnonzero(shares[0]).tolist() == [0, 2]
    assert shares[0, 2] == pytest.approx(0.015, abs=0.004)


def test_language_odd_rows(odd, nothing, documents):
    model = language.learn(documents)
    by_id = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [by_id[i]["lang_pred"] for i in (3, 4, 5, 6)] == ["und"] * 4
    assert by_id[7]["lang_pred"] != "und" and 0 < by_id[7]["score"] <= 1
    assert language.identify(nothing, model).count() == 0
    assert language.identify(odd, language.learn(nothing)).filter("lang_pred <> 'und'").count() == 0


def test_quality_separates_and_shrinks(spark, odd, nothing):
    found = quality.rate(*[spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")])
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)
    no_labels = labels.limit(0)
    rows = quality.rate(odd, no_labels).collect()
    assert len(rows) == 14 and all(abs(r["score"] - 0.5) < 1e-9 for r in rows)
    assert quality.rate(nothing, no_labels).count() == 0


def test_quality_fits_one_row_per_labelled_id(spark, monkeypatch):
    sizes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append(len(y)) or fit(x, y))
    docs = spark.createDataFrame([(1, f"Repeated id {i}.", "s", "en") for i in range(50)] + [(2, "bad bad", "s", "en")],
                                 "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.rate(docs, labels).count() == 51 and sizes == [2]


def test_sparse_hosts_are_shrunk(spark):
    rows = ([(f"big{h}", 1.0, 40.0, 36.0 - 8 * h) for h in range(4)] + [("tiny", 1.0, 1.0, 0.0)])
    groups = spark.createDataFrame([(h, n, t, 0.75, n * 0.1) for h, _, n, t in rows],
                                   "host string, n double, total double, above double, inner double")
    assert 1 <= quality._strength(groups, "above") < 40


# --- packing, pipeline -----------------------------------------------------------------

def check_packing(texts, pieces):
    """Every id lies in one piece, sequences are gapless and full or a power of two long."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    keys = list(texts)
    encoded = tokenizer.encode_batch([texts[k] or "" for k in keys], add_special_tokens=False)
    expected = {k: [*e.ids, 0] for k, e in zip(keys, encoded)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(keys)
    for k in keys:
        found = []
        for start, ids, total in sorted(by_doc[k]):
            assert start == len(found) and total == len(expected[k])
            found += ids
        assert found == expected[k]
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0 and end < 1024


def test_packing_is_a_round_trip(documents):
    rows = documents.select("doc_id", "text").collect()
    check_packing(dict(map(tuple, rows)), packing.pack(documents, queries.tokenizer_file()).collect())


def test_packing_odd_texts(spark, odd, nothing):
    rng = random.Random(2)
    parts = ["a", "B ", "  ", " \n", "\n", "\t", " it's", " 12", "é", " ’", "​", "!? ", "　", "\x85", "x,y", "<|endoftext|>"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for i in range(300)}
    texts |= {900: None, 901: "", 902: "word " * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check_packing(texts, packing.pack(df, queries.tokenizer_file()).collect())
    assert packing.pack(odd, queries.tokenizer_file()).filter("doc_id is null").count() >= 1
    assert packing.pack(nothing, queries.tokenizer_file()).count() == 0


def test_remembered_words_are_bounded(spark):
    text = pa.array([" ".join(f"w{i * 7919 % 5003}x" for i in range(j, j + 300)) for j in range(0, 6000, 300)])
    words_, seen = tokens.words_of(queries.tokenizer_file(), 700), []
    try:
        for row, ids in zip(text.to_pylist(), tokens.encode(text, words_, 1 << 11), strict=True):
            assert ids.tolist() == words_.whole(row)
            seen.append(len(words_))
        assert max(seen) <= 700
        assert len(tokens.words_of(queries.tokenizer_file())) <= 700 and words_.most == tokens.CACHED_WORDS
    finally:
        words_.clear()
    df = spark.createDataFrame(list(enumerate(text.to_pylist())), "doc_id long, text string").repartition(2)
    few = packing.pack(df, queries.tokenizer_file(), block_bytes=1 << 11, keep_words=False, most_words=700)
    every = packing.pack(df, queries.tokenizer_file())
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect()))


def test_sum_of_squares_picks_the_least_sum():
    rng = random.Random(4)
    packer, level_of = packing.SumOfSquares(32), Counter()
    for i in range(500):
        size = rng.randint(1, 32)

        def total(level):
            after = level_of.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return sum(v * v for v in after.values())

        options = [0, *[h for h, n in level_of.items() if n and h + size <= 32]]
        chosen = packer.level(size)
        assert chosen in options and total(chosen) == min(map(total, options))
        packer.place((i, 0, b"", size), size)
        if chosen:
            level_of[chosen] -= 1
        if chosen + size < 32:
            level_of[chosen + size] += 1


def test_pipeline_stages_match_brute_force(spark, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    known = {k: t for k, t in rows.items() if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in kept["language_id"].collect()} == set(known)
    cut = by_lines(list(known.items()))
    cut = {k: t for k, t in cut.items() if t.strip() or not known[k].strip()}
    assert {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()} == cut
    keys = sorted(cut)
    roots = components([word_shingles(cut[k]) for k in keys])
    left = {keys[i] for i, r in enumerate(roots) if i == r}
    assert {r["doc_id"] for r in kept["jaccard_join"].collect()} == left
    mixed = Counter(r["doc_id"] for r in kept["source_mixing"].collect())
    assert set(mixed) <= left and max(mixed.values()) <= 4
    n_words = lambda df: sum(len(words(r["text"])) for r in df.select("text").collect())
    assert n_words(kept["source_mixing"]) == pytest.approx(n_words(kept["jaccard_join"]), abs=40)
    assert set(r["doc_id"] for r in kept["packing"].collect()) == set(mixed)


def test_pipeline_keeps_texts_without_a_language(spark, odd):
    unnamed = odd.withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.identify_language(spark, unnamed, SF)
    assert found.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in found.collect()) == [0, 1, 2, 7, 8, 9, 9, 10, 11, 12]


def test_pipeline_gives_workers_small_batches(spark):
    key, most = corpus_pipeline.ARROW_BATCH[0], int(corpus_pipeline.ARROW_BATCH[1])
    text = "some words of a text " * 1000
    docs = spark.createDataFrame([(i, f"{i} {text}", "en", "a") for i in range(500)],
                                 "doc_id long, text string, lang string, source string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset(key)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs.limit(0), SF)
            if stage is not corpus_pipeline.mix_sources:  # no Python in it
                found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
                assert len(found) >= 5 and max(found) <= most + 2 * len(text)
        spark.conf.set(key, "1234567")
        corpus_pipeline.pack_sequences(spark, docs, SF)
        assert spark.conf.get(key) == "1234567"
    finally:
        spark.conf.unset(key)


def test_pipeline_takes_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "odd")
        docs.collect()


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names
