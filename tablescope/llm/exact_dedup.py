"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, bounded, materialise

#: Code points that the second step hashes.
PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept and the columns of `carry`.

    Texts are equal when they are identical after lower-casing A-Z only; a null text
    counts as empty. Of equal texts the row with the largest id stays.

    Three steps of rising cost, each over the survivors of the one before: texts whose
    byte length no other text has are unique; so are texts whose first characters no
    text of that length shares; only the rest are hashed whole (SHA-256). Text never
    enters a shuffle while the survivors' keys fit a broadcast; beyond that one join on
    (length, prefix hash) moves it. Counts are combined before they are shuffled, so a
    text owning a third of all rows is one row per task.

    Null ids are never larger than others; rows of a group whose ids are all null share
    keep_id null and are kept. Rows that repeat an id and its text are one document and
    get the same verdict. Extra columns are ignored, whatever their names. An empty
    table gives an empty result. `carry` takes expressions over `docs` to pass through.
    """
    carry = carry or {}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    scan = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"),
                       F.octet_length(text).alias("_len"),
                       F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("_head"),
                       *[c.alias(f"_carry_{n}") for n, c in carry.items()])

    lengths = scan.groupBy("_len").count().filter("count > 1").select("_len")
    lengths = bounded(materialise(lengths, "exact-lengths"))
    heads = (scan.select("_len", "_head").join(lengths, "_len", "left_semi")
             .groupBy("_len", "_head").count().filter("count > 1")
             .select("_len", "_head", F.lit(True).alias("_open")))
    heads = bounded(materialise(heads, "exact-heads"))

    whole = F.when(F.col("_open"), F.unhex(F.sha2(ascii_lower(F.col("_text")), 256)))
    rows = (scan.join(heads, ["_len", "_head"], "left")
            .select("_id", "_len", whole.alias("_whole"), *[f"_carry_{n}" for n in carry]))
    rows = materialise(rows, "exact-rows")

    groups = (rows.filter("_whole is not null").groupBy("_whole")
              .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).filter("_n > 1"))
    groups = bounded(materialise(groups, "exact-groups"))
    passed = [F.col(f"_carry_{n}").alias(n) for n in carry]

    def out(df: DataFrame, keep: Column, n: Column) -> DataFrame:
        return df.select(F.col("_id").alias(id_col), keep.alias("keep_id"), n.alias("group_size"),
                         F.col("_id").eqNullSafe(keep).alias("kept"), *passed)

    # unique rows skip the join, else they would all meet under the null key
    alone = out(rows.filter("_whole is null"), F.col("_id"), F.lit(1).cast("long"))
    found = out(rows.filter("_whole is not null").join(groups, "_whole", "left"),
                F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")),
                F.coalesce(F.col("_n"), F.lit(1).cast("long")))
    return alone.unionAll(found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay; of repeated (id, text) rows one."""
    keys = exact_groups(docs, id_col, text_col).filter("kept").select(
        F.col(id_col).alias("_kept_id")).distinct()
    return (docs.dropDuplicates([id_col, text_col])
            .join(keys, F.col(f"`{id_col}`").eqNullSafe(F.col("_kept_id")), "left_semi"))
