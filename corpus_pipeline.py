"""From raw documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the
columns of the table; the last gives pieces of sequences. Every stage is written as
Parquet before the next one reads it. Workers live on from stage to stage, so all stages
give them small batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm import jaccard_join, language, line_dedup, mixing, packing
from tablescope.llm.common import materialise, share_code, table
from tablescope.llm.queries import tokenizer_file

#: Bytes of rows that go to a Python worker at a time, in place of Spark's 64 MB. Both sides
#: hold copies of a batch, and a worker keeps the memory of its largest.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def _prepared(spark: SparkSession) -> None:
    """Let workers find this code and get small batches, unless the session says how large."""
    share_code(spark)
    if spark.conf.get(ARROW_BATCH[0], None) is None:
        spark.conf.set(*ARROW_BATCH)


def _recounted(docs: DataFrame) -> DataFrame:
    """Documents whose text a stage cut, with their lengths brought up to date."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", n)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without any letter go. The model learns from
    this stage's own labelled documents; if it knows no language, all texts with a letter
    stay."""
    _prepared(spark)
    model = language.learn(docs.filter(~language.held_out()))
    if not model[0]:
        return docs.filter(language.has_letter())
    found = language.identify(docs, model)
    return found.filter(f"lang_pred <> '{language.UNKNOWN}'").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they repeat from earlier documents. One that had
    lines and lost all of them has nothing of its own and goes."""
    _prepared(spark)
    found = line_dedup.dedup_lines(docs)
    return _recounted(found.filter("n_removed < n_lines or n_lines = 0").select(*docs.columns))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    _prepared(spark)
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _recounted(mixing.repeated(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. Workers of earlier stages are still there, so
    they are given little memory."""
    _prepared(spark)
    return packing.pack(docs, tokenizer_file(), block_bytes=1 << 18, keep_words=False, most_words=1 << 17)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, MinHash, token ids and the order of packing are not SQL; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
