"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in its source's sample is a number of 6 hexadecimal digits, found
#: in two steps of 3, so each step counts at most 4096 cells a source.
CELLS = 4096


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _dec(c) -> F.Column:
    """A sum of words as an exact number wide enough for products."""
    return F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """Rows of `sources` with `place`, 0 up, by code point, null last.

    Sorted by range partitions: a place is the row's number in its partition plus the
    rows of the partitions before it, so no task sorts them all.
    """
    null_last = [F.col(key).isNull().alias("_null"), F.col(key)]
    parts = materialise(
        sources.repartitionByRange(*[F.col(key).isNull(), F.col(key)])
        .withColumn("_part", F.spark_partition_id()), "mix-order")
    within = Window.partitionBy("_part").orderBy(*null_last)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    return (parts.join(before, "_part")
            .withColumn("place", F.row_number().over(within) - 1 + F.col("_before"))
            .drop("_part", "_before"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sources` (source_size, weight) with `target`: their share of all sizes by weight.

    A source whose share is above `max_epochs` times its size is clamped there and what
    it can't take is dealt again by weight among the rest, until none is above. Each
    round is one aggregate; the driver sees three sums. The level only rises, so a
    clamped source stays clamped and the rounds end.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = _dec("source_size") * max_epochs
    rest, weight, n_clamped = total, None, -1
    clamped = F.lit(False)
    while True:
        if weight is None:
            weight = sources.agg(F.sum("weight")).first()[0] or 1
        else:
            clamped = cap * F.lit(weight) < _dec("weight") * F.lit(rest).cast("decimal(38,0)")
            sums = sources.agg(F.count_if(clamped), F.sum(F.when(clamped, cap)),
                               F.sum(F.when(~clamped, F.col("weight")))).first()
            if sums[0] == n_clamped:
                break
            n_clamped, rest, weight = sums[0], total - int(sums[1] or 0), int(sums[2] or 1)
    share = f"cast(weight as decimal(38,0)) * cast({rest} as decimal(38,0))"
    full = F.col("source_size") * max_epochs
    return (sources
            .withColumn("target", F.when(clamped, full.cast("double"))
                        .otherwise(F.expr(f"cast({share} as double)") / F.lit(float(weight))))
            .withColumn("target_words", F.when(clamped, full)
                        .otherwise(F.expr(f"{share} div cast({weight} as decimal(38,0))"))))


def _boundary(cells: DataFrame, cell: str, want: str) -> DataFrame:
    """Per source the cell in which the running sum of words passes `want`, with the words
    before it. `cells` has at most CELLS rows a source."""
    run = Window.partitionBy("_src").orderBy(cell)
    return (cells.withColumn("_upto", F.sum("_words").over(run))
            .withColumn("_under", F.col("_upto") - F.col("_words"))
            .filter(F.col("_under") <= F.col(want)).filter(F.col("_upto") > F.col(want)))


def _plan(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: str, id_col: str,
          text_col: str, source_col: str, carry: Sequence[str]) -> DataFrame:
    """Every row's id, numbers and, under names of their own, the columns of `carry`."""
    text = F.col(f"`{text_col}`")
    digits = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    place = F.conv(F.substring(digits, 1, 6), 16, 10).cast("long")
    rows = materialise(docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_src"),
        n_words(text).alias("_size"), place.alias("_place"),
        *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry]), "mix-rows")

    sources = rows.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    picks = F.array(*[F.lit(int(w)) for w in weights])
    sources = materialise(ranked(materialise(sources, "mix-sources"), "_src").withColumn(
        "weight", F.get(picks, (F.col("place") % len(weights)).cast("int"))), "mix-weights")
    targets = water_fill(sources, max_epochs).withColumn("repeats", F.when(
        F.col("source_size") > 0, F.expr("target_words div source_size")).otherwise(F.lit(0).cast("long")))
    targets = materialise(targets.withColumn(
        "_lack", F.col("target_words") - F.col("repeats") * F.col("source_size")).drop("weight", "place"),
        "mix-targets")

    same = lambda other: F.col("_src").eqNullSafe(F.col(other))
    lacking = targets.filter("_lack > 0").select(F.col("_src").alias("_s"), "_lack")
    coarse = (rows.groupBy("_src", F.expr(f"_place div {CELLS}").alias("_cell"))
              .agg(F.sum("_size").alias("_words")))
    first = (_boundary(coarse.join(bounded(lacking), same("_s")).drop("_s"), "_cell", "_lack")
             .select(F.col("_src").alias("_s"), F.col("_cell").alias("_c"),
                     (F.col("_lack") - F.col("_under")).alias("_more")))
    first = bounded(materialise(first, "mix-first"))
    fine = (rows.join(first, same("_s") & (F.expr(f"_place div {CELLS}") == F.col("_c")))
            .groupBy("_src", "_place", "_more").agg(F.sum("_size").alias("_words")))
    edge = (_boundary(fine, "_place", "_more")
            .select(F.col("_src").alias("_s"), F.col("_place").alias("_edge"),
                    (F.col("_more") - F.col("_under")).alias("_part"), F.col("_words").alias("_of")))
    plan = bounded(materialise(
        targets.join(edge, same("_s"), "left").drop("_s").withColumnRenamed("_src", "_s"), "mix-plan"))

    joined = rows.join(plan, same("_s"))
    once = (F.col("_place") < F.col("_edge")).cast("long")
    part = F.when(F.col("_place") == F.col("_edge"), F.expr(
        "cast(_size as decimal(38,0)) * cast(_part as decimal(38,0)) div cast(_of as decimal(38,0))"))
    return (joined.withColumn("repeats", F.col("repeats") + F.coalesce(once, F.lit(0).cast("long")))
            .withColumn("extra", F.coalesce(part, F.lit(0).cast("long"))))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: str = "", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, repeats, extra, taken.

    Sources in order of code point, null last, weigh `weights` in turn and share all
    words by water-filling. A source is taken whole `repeats` times; the words still
    lacking come from documents in the order of a hash of `seed` and id. Those before the
    boundary are taken once more. The boundary is found by two rounds of at most 4096
    counted cells per source, so no source is ever sorted or gathered; the documents of
    the last cell, one or few, give the fraction still lacking (`extra` words each,
    rounded down). So a source's words miss the target by less than its last cell's
    number of documents, and no document is taken more than `max_epochs` times.

    A null text has size 0; null sources form a source of their own; rows with the same
    id take part alike; sources without words take nothing. Extra columns do no harm. An
    empty table gives an empty result. Nothing depends on the partitioning.
    """
    plan = _plan(docs, weights, max_epochs, seed, id_col, text_col, source_col, ())
    return plan.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "repeats",
        "extra", (F.col("repeats") * F.col("_size") + F.col("extra")).alias("taken"))


def repeated(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
             seed: str = "", id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of
    `docs`; a part of a repetition holds the document's first words. A document that is
    taken zero times goes."""
    plan = _plan(docs, weights, max_epochs, seed, id_col, text_col, source_col, docs.columns)
    text = F.col(f"_carry_{text_col}")
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1),
                                 1, F.col("extra").cast("int")), " ")
    whole = plan.filter("repeats > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    part = plan.filter("extra > 0")
    out = [F.col(f"_carry_{c}").alias(c) for c in docs.columns]
    cut = [words.alias(c) if c == text_col else F.col(f"_carry_{c}").alias(c) for c in docs.columns]
    return whole.select(*out).unionAll(part.select(*cut))
