"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import blocks, mix
from .common import materialise

#: Bytes of an n-gram and hash buckets of the model. The model has BUCKETS numbers per
#: language, which bounds what is sent to the tasks whatever the size of the corpus.
ORDER = 3
BUCKETS = 1 << 16
SMOOTHING = 0.5
EM_ROUNDS, REFIT_ROUNDS = 6, 4
#: A language joins the set of a document if it raises the log-likelihood by more than
#: this many times half the logarithm of the n-grams (the penalty of one proportion).
PENALTY = 4.0
UNKNOWN = "und"


def ngram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the ORDER bytes from each place on, within its row: buckets and bounds.

    A-Z is lower-cased; digits and ASCII signs count as blanks.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    data = np.where((data < 97) | ((data > 122) & (data < 128)), np.uint8(32), data).astype(np.uint64)
    n = max(0, len(data) - ORDER + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(ORDER):
        h = h << np.uint64(8) | data[j:j + n]
    found = (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
    sizes = np.maximum(0, np.diff(bounds) - ORDER + 1)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    own = np.repeat(bounds[:-1] - upto[:-1], sizes) + np.arange(upto[-1])
    return found[own], upto


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name and the logarithms of their n-gram probabilities.

    Every task counts its rows into BUCKETS numbers per language; the sums are one grouped
    aggregate. Rows without text or language teach nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for first, last, data, bounds in blocks(batch.column("text")):
                found, upto = ngram_buckets(data, bounds)
                order = np.array(names[first:last], dtype=object)
                codes = np.repeat(np.arange(last - first), np.diff(upto))
                for name in set(names[first:last]):
                    mine = (order == name)[codes]
                    counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    counts[name] += np.bincount(found[mine], minlength=BUCKETS)
        for name, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)),
                 pa.array(n[used])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        "lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    table = sums.toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.full((len(langs), BUCKETS), SMOOTHING)
    at = {name: i for i, name in enumerate(langs)}
    counts[table["lang"].map(at).to_numpy(dtype=np.int64), table["bucket"].to_numpy()] += table["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _mixtures(likely: np.ndarray, weight: np.ndarray, bounds: np.ndarray, allowed: np.ndarray,
              share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the shares of the allowed languages in each document, and the log-likelihoods.
    `likely` has a row per distinct n-gram of a document, `weight` its count."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(weight, bounds[:-1])[:, None]
    share = np.where(allowed, share, 0)
    share /= share.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        resp = likely * share[owner]
        resp *= (weight / resp.sum(axis=1))[:, None]
        share = np.add.reduceat(resp, bounds[:-1], axis=0) / total
    top = (likely * share[owner]).sum(axis=1)
    return share, np.add.reduceat(weight * np.log(top), bounds[:-1], dtype=np.float64)


def _additions(likely: np.ndarray, weight: np.ndarray, bounds: np.ndarray, mixed: np.ndarray,
               share: np.ndarray, rounds: int) -> np.ndarray:
    """What each language adds to the log-likelihood of each document if it joins the
    present mixture `mixed` (likelihoods of the n-grams), each alone: EM for its share."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = weight[:, None]
    total = np.add.reduceat(weight, bounds[:-1])
    ratio = likely / np.maximum(mixed, np.float32(1e-30))[:, None]
    share = np.clip(share, 1e-3, 0.5)
    for _ in range(rounds):
        part = share[owner] * ratio
        share = np.add.reduceat(weight * part / (1 - share[owner] + part), bounds[:-1], axis=0) / total
    gain = weight * np.log1p(share[owner] * (ratio - 1))
    return np.add.reduceat(gain, bounds[:-1], axis=0, dtype=np.float64)


def _rows_of(bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given documents one after the other, and their bounds."""
    return (np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in docs]),
            np.concatenate([[0], np.cumsum(np.diff(bounds)[docs])]))


def infer(logs: np.ndarray, found: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages per document, of the language set that the penalised
    likelihood selects, and the number of languages in that set.

    EM over all languages gives the shares to start from. The set starts with the likeliest
    single language. It takes on the language that adds most beside the present mixture,
    if the refitted log-likelihood gains more than the penalty; else the next one is tried,
    until no language outside the set is left. How small a share may be follows from the
    penalty alone.
    """
    n_docs, n_langs = len(upto) - 1, len(logs)
    grams, weights, sizes = [], [], []
    for low, high in zip(upto[:-1].tolist(), upto[1:].tolist()):
        one, n = np.unique(found[low:high], return_counts=True)
        grams.append(one)
        weights.append(n)
        sizes.append(len(one))
    shares = np.zeros((n_docs, n_langs), np.float32)
    langs_in = np.zeros(n_docs, np.int64)
    some = np.flatnonzero(np.array(sizes) > 0)
    if not len(some):
        return shares, langs_in
    bounds = np.concatenate([[0], np.cumsum(np.array(sizes)[some])])
    weight = np.concatenate([weights[i] for i in some]).astype(np.float32)
    log = logs[:, np.concatenate([grams[i] for i in some])].T
    best = log.max(axis=1)
    likely = np.exp(log - best[:, None])
    alone = np.add.reduceat((log - best[:, None]) * weight[:, None], bounds[:-1], axis=0, dtype=np.float64)
    every = np.ones((len(some), n_langs), bool)
    full, _ = _mixtures(likely, weight, bounds, every, every.astype(np.float32), EM_ROUNDS)
    rows = np.arange(len(some))
    first = alone.argmax(axis=1)
    allowed = np.zeros_like(every)
    allowed[rows, first] = True
    now, value = allowed.astype(np.float32), alone[rows, first]
    penalty = PENALTY * 0.5 * np.log(np.maximum(2, np.add.reduceat(weight, bounds[:-1])))
    gains = np.full(every.shape, -np.inf)
    live = fresh = rows
    while len(live):
        if len(fresh):
            parts, ends = _rows_of(bounds, fresh)
            mixed = (likely[parts] * now[fresh][np.repeat(np.arange(len(fresh)), np.diff(ends))]).sum(axis=1)
            gains[fresh] = _additions(likely[parts], weight[parts], ends, mixed, full[fresh], EM_ROUNDS)
            gains[allowed] = -np.inf
        after = gains[live].argmax(axis=1)
        # beside a single language the gain is that of the refit; beside more it is less
        go = np.where(allowed[live].sum(axis=1) == 1, gains[live, after] > penalty[live], gains[live, after] > -np.inf)
        live, after = live[go], after[go]
        if not len(live):
            break
        trial = allowed[live]
        trial[np.arange(len(live)), after] = True
        parts, ends = _rows_of(bounds, live)
        share, got = _mixtures(likely[parts], weight[parts], ends, trial,
                               np.maximum(full[live], 1e-3), REFIT_ROUNDS)
        gains[live, after] = -np.inf
        better = got - value[live] > penalty[live]
        fresh = live[better]
        allowed[fresh], now[fresh], value[fresh] = trial[better], share[better], got[better]
    shares[some], langs_in[some] = now, allowed.sum(axis=1)
    return shares, langs_in


def has_letter(text_col: str = "text"):
    """False for a null text, too."""
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text",
             columns: list[str] | None = None) -> DataFrame:
    """The rows and columns (or the given ones) of `docs` with lang_pred, score, lang_set and lang_shares.

    lang_pred is the language with the largest share of the document and score that share;
    lang_set the selected languages by falling share with lang_shares. A text without any
    letter, an empty and a null one are `und` with score 0 and an empty set, as is any
    text if the model knows no language. Columns of those names are replaced; other
    columns pass through. The whole text counts, whatever its length.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    new = ["lang_pred", "score", "lang_set", "lang_shares"]
    own = [c for c in (docs.columns if columns is None else columns) if c not in new]
    rows = docs.select(*dict.fromkeys([*own, text_col]), has_letter(text_col).alias("_letter"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for first, last, data, bounds in blocks(batch.column(text_col), 1 << 19):
                n = last - first
                part = batch.slice(first, n)
                shares = np.zeros((n, max(1, len(langs))), np.float32)
                if len(langs):
                    found, upto = ngram_buckets(data, bounds)
                    shares, _ = infer(logs, found, upto)
                letter = np.array(part.column("_letter").to_pylist(), dtype=bool)
                # letters in a text too short for an n-gram: all languages are as likely
                short = letter & (shares.sum(axis=1) == 0) & bool(len(langs))
                shares[short] = 1 / max(1, len(langs))
                shares[~letter] = 0
                sets = [[j for j in np.argsort(-s, kind="stable") if s[j] > 0] for s in shares]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in own],
                     pa.array([langs[s[0]] if s else UNKNOWN for s in sets], pa.string()),
                     pa.array([float(min(1.0, x[s[0]])) if s else 0.0 for s, x in zip(sets, shares)], pa.float64()),
                     pa.array([[langs[j] for j in s] for s in sets], pa.list_(pa.string())),
                     pa.array([[float(x[j]) for j in s] for s, x in zip(sets, shares)], pa.list_(pa.float64()))],
                    names=[*own, *new])

    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, "
                                "lang_set array<string>, lang_shares array<double>")


def held_out(id_col: str = "doc_id"):
    """Documents that are not learned from: a quarter, by the checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
