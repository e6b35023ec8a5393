"""Whitening against the eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors, scale=64, shift=1_000_000):
    """x, sums and deviations in Python's whole numbers."""
    x = [[math.floor(scale * c) + shift for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    return x, sums, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]


def check(rows, vectors, ids, k=32):
    x, sums, deviations = exact(vectors)
    n, dim = len(x), len(x[0])
    c = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1], turn[:, ::-1]
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by_id) == sorted(ids) and len(rows) == n * min(k, dim)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] <= 1e-9
    z = np.array([[by_id[i][j]["whitened"] for j in range(1, min(k, dim) + 1)] for i in ids])
    for i, d in zip(ids, deviations):
        assert {r["deviation"] for r in by_id[i].values()} == {d} and {r["n"] for r in by_id[i].values()} == {n}
    for j in range(min(k, dim)):
        want = c @ turn[:, j] / np.sqrt(values[j])
        gap = min(abs(values[j] - v) for m, v in enumerate(values) if m != j) / values[0]
        assert min(np.abs(z[:, j] - want).max(), np.abs(z[:, j] + want).max()) <= 1e-11 / gap * np.abs(want).max()
        assert by_id[ids[0]][j + 1]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-10)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_matches_the_whole_covariance(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = queries.QUERIES["op13_whitening"](spark, sf_dir).collect()
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(rows, [[float(c) for c in r["embedding"]] for r in source], [r["vec_id"] for r in source])


def test_filter_converges_without_widening(spark):
    """A falling spectrum over 150 dimensions is certified within the first block."""
    rng = np.random.default_rng(3)
    scales = 0.93 ** np.arange(150) * 30
    made = (rng.standard_normal((1500, 150)) * scales) @ np.linalg.qr(rng.standard_normal((150, 150)))[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>").repartition(5)
    blocks = whitening.Blocks(whitening.usable(df, "embedding"), "embedding", 64, 1_000_000)
    widths, times = set(), blocks.times
    blocks.times = lambda q: widths.add(q.shape[1]) or times(q)
    fit = whitening.components(blocks, 32)
    assert widths == {40} and fit.residual <= whitening.TOLERANCE * fit.values[0]
    c = np.floor(made * 64)
    c -= c.mean(axis=0)
    values = np.linalg.eigvalsh(c.T @ c / len(c))[::-1]
    assert np.allclose(fit.values, values[:32], rtol=1e-11)
    residual = c.T @ (c @ fit.vectors) / len(c) - fit.vectors * fit.values
    assert np.linalg.norm(residual, axis=0).max() <= 1e-12 * values[0]


def test_flat_spectrum_widens_until_exact(spark):
    made = np.random.default_rng(5).standard_normal((900, 100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    check(rows, made.tolist(), list(range(900)))


def test_partial_sums_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    made = np.random.default_rng(6).standard_normal((200, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>").repartition(9)
    check(whitening.whiten(df).collect(), made.tolist(), list(range(200)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [0.25, -3.0]), (2, [0.25, -3.0]), (None, [4.0, 0.125]), (3, None), (4, [1.0, None]),
            (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("x")).withColumn("n", F.lit(7)).withColumn("part", F.lit(7))
    found = whitening.whiten(df).collect()
    fit = [v for _, v in rows[:4]]
    _, _, deviations = exact(fit)
    assert sorted((r["vec_id"] or 0, r["component"], int(r["deviation"])) for r in found) == sorted(
        (i or 0, j, d) for (i, _), d in zip(rows, deviations) for j in (1, 2))
    assert found[0]["identity_error"] < 1e-12
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert [(r["component"], r["whitened"], r["explained"], int(r["deviation"])) for r in whitening.whiten(same).collect()] == [
        (j, None, 0.0, 0) for _ in (1, 2) for j in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], SCHEMA)
    assert {(r["component"], r["whitened"] is None) for r in whitening.whiten(line).collect()} == {(1, False), (2, True)}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id in (3, 4)")).count() == 0


def test_large_numbers_stay_exact(spark):
    made = [[1e9 * i, -3e10 * i * i, float(i)] for i in range(40)]
    df = spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")
    _, _, deviations = exact(made)
    found = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df).collect()}
    assert found == dict(enumerate(deviations))
    whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
