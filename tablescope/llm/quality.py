"""Quality by hierarchical empirical Bayes: documents, hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import blocks, word_hashes
from .common import bounded, materialise

#: Labelled rows that the document classifier is fitted on, at most: those with the least
#: hash of the id. All else, the posteriors of hosts and paths, covers every row.
FIT_ROWS = 20_000
RIDGE = 1.0
FEATURES = ("upper", "digit", "bang", "bar", "sign", "space", "beyond_ascii", "repeated",
            "distinct", "word_length", "log_words", "line_words", "end_mark")
#: Evidence is kept this far from 0 and 1.
MARGIN = 1e-4


def style(column: pa.Array) -> np.ndarray:
    """A row of FEATURES per text: shares of kinds of characters, of words that repeat the
    one before, of distinct words, and mean sizes."""
    out = []
    for first, last, data, bounds in blocks(column):
        def per_row(mask: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(mask)])
            return run[bounds[1:]] - run[bounds[:-1]]

        n_bytes = np.maximum(1, np.diff(bounds))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        sign = (data > 32) & (data < 128) & ~((data >= 48) & (data <= 57)) & ~(
            ((data | 32) >= 97) & ((data | 32) <= 122))
        usual = (data == 44) | (data == 46)
        words, at = word_hashes(data, bounds)
        n_words = np.diff(at)
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], words[1:] == words[:-1]])[:len(words)])])
        # a row's first word repeats nothing
        repeated = same[at[1:]] - same[np.minimum(at[:-1] + 1, at[1:])]
        distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        some = np.maximum(1, n_words)
        lines = per_row(data == 10) + 1
        out.append(np.column_stack([
            per_row((data >= 65) & (data <= 90)) / n_bytes,
            per_row((data >= 48) & (data <= 57)) / n_bytes,
            per_row(data == 33) / some, per_row(data == 124) / some,
            per_row(sign & ~usual & (data != 33) & (data != 124)) / some,
            per_row(space) / n_bytes, per_row(data >= 128) / n_bytes,
            repeated / some, distinct / np.sqrt(some), (n_bytes - per_row(space)) / some,
            np.log1p(n_words), np.log1p(n_words / lines), per_row(data == 46) / some]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _styled(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """`columns` of `docs` and their features, an array of doubles."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = style(batch.column(text_col))
            ends = pa.array(np.arange(0, found.size + 1, len(FEATURES)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.ListArray.from_arrays(ends, pa.array(found.ravel()))],
                names=[*columns, "features"])

    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(run, f"{fields}, features array<double>")


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps: weights for raw features, the constant last."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(len(FEATURES)), np.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.append(np.full(len(FEATURES), RIDGE), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: str) -> float:
    """How many documents the prior of a level is worth, by the method of moments: groups
    (n, total, prior, inner variance) that differ by no more than chance give a large
    number, which shrinks them fully."""
    mean = F.col("total") / F.col("n")
    got = groups.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum("inner"),
        F.sum(F.col("n") * (mean - F.col(prior)) ** 2), F.sum(F.col("n") * F.col("n"))).first()
    n, k, inner, between, squares = (float(v or 0) for v in got)
    if k < 2 or n <= k:
        return 1e6
    within = inner / (n - k)
    spread = (between - (k - 1) * within) / max(1.0, n - squares / n)
    return min(1e6, max(1.0, within / spread)) if spread > 0 else 1e6


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """One row per row of `docs`: id, evidence, host_posterior, path_posterior, score, keep.

    1. Evidence: the probability that a document is good by a logistic classifier on
       FEATURES of its whole text, fitted on at most FIT_ROWS labelled rows,
       one text per id and label.
    2. Host posterior: the mean evidence of a host's documents, shrunk to the mean of all
       as if that were worth a number of documents, which the method of moments estimates
       from the spread between hosts against that within. Sparse hosts stay close to it.
    3. Path posterior: the same for the documents of a host that share `path_col`, shrunk
       to their host's posterior.
    4. Score: the evidence's odds times the odds of the path against those of all. keep is
       score >= 0.5.

    Levels are grouped aggregates, combined before they are shuffled; a host with a third
    of all rows is one row per task. Documents join their path's few numbers.

    A null text is empty (and its features are those of an empty text); null hosts and
    paths are groups of their own; labels that are null, or of unknown ids, teach nothing;
    rows that repeat an id are rated each; without labels the evidence is 0.5 everywhere.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
             .filter("id is not null and y is not null"))
    # the sample is drawn from ids that have a text, before any text moves
    chosen = marks.join(rows.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id", "y").limit(FIT_ROWS)
    chosen = bounded(materialise(chosen, "quality-marks"))
    styled = materialise(_styled(rows, ["id", "host", "path"], "text"), "quality-features")
    # one row per chosen id and label, as an id may be repeated without bound
    known = styled.join(chosen.distinct(), "id").groupBy("id", "y").agg(
        F.min_by("features", F.xxhash64("features")).alias("features")).select("features", "y").toPandas()
    x = np.array(known["features"].tolist()).reshape(-1, len(FEATURES))
    weights = fit(x, known["y"].to_numpy())

    z = F.aggregate(F.zip_with("features", F.array(*[F.lit(float(w)) for w in weights[:-1]]),
                               lambda a, b: a * b), F.lit(float(weights[-1])), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    p = F.greatest(F.lit(MARGIN), F.least(F.lit(1 - MARGIN), p))
    evidence = materialise(styled.select("id", "host", "path", p.alias("p")), "quality-evidence")

    sums = (F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"),
            F.coalesce(F.var_pop("p") * F.count(F.lit(1)), F.lit(0.0)).alias("inner"))
    mean = evidence.agg(F.avg("p")).first()[0]
    mean = 0.5 if mean is None else mean
    hosts = materialise(evidence.groupBy("host").agg(*sums).withColumn("above", F.lit(mean)), "quality-hosts")
    worth = _strength(hosts, "above")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("total") + worth * mean) / (F.col("n") + worth))
                         .alias("host_posterior"))
    paths = evidence.groupBy("host", "path").agg(*sums)
    paths = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-paths")
    worth = _strength(paths, "host_posterior")
    paths = materialise(paths.select(
        F.col("host").alias("h"), F.col("path").alias("q"), "host_posterior",
        ((F.col("total") + worth * F.col("host_posterior")) / (F.col("n") + worth)).alias("path_posterior")),
        "quality-posteriors")
    joined = evidence.join(bounded(paths), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_posterior",
                         "path_posterior", score.alias("score"), (score >= 0.5).alias("keep"))
