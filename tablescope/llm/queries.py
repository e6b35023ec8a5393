"""The registered queries of this subpackage: QUERIES and ORACLES by name.

Each applies one operator, with production parameters, to its whole table and derives
the columns asked for from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.session import scratch_path

from . import (exact_dedup, html_text, id_planes, jaccard_join, language, line_dedup, mixing, neighbours,
               packing, prefix_trie, quality, warc, whitening)
from .common import ascii_lower, materialise, table


def tokenizer_file() -> str:
    """The public byte-level tokenizer that the queries encode with."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text", language.held_out().alias("held_out")),
                              model, columns=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "lang_set", "lang_shares")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return records.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry={
        "text_sha256": F.sha2(ascii_lower(text), 256)})


def op11_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    index = id_planes.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_file())
    found = id_planes.read_documents(index, folder)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    convs = materialise(convs, "conversations")
    rebuilt = prefix_trie.with_shared_heads(convs, c - c % 20, F.crc32(c.cast("string")) % 4)
    return prefix_trie.prefix_nodes(rebuilt).drop("turn_key").withColumn("depth", F.col("depth").cast("long"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_mixing, op3_quality, op4_language, op5_neighbours, op6_html_text, op7_warc,
    op8_packing, op9_jaccard_join, op10_exact_dedup, op11_id_planes, op12_prefix_trie, op13_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 6))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS weight
  FROM d GROUP BY source),
r AS (  -- in order of the level at which a source is full: words and weight of those still open
  SELECT *, row_number() OVER before AS k, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM s WINDOW before AS (ORDER BY 3 * source_size::DOUBLE / weight, source_size, encode(source) NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (  -- the first that does not overflow sets the level
  SELECT words, open_weight FROM r WHERE weight * words <= 3 * source_size * open_weight
  ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, weight * level.words > 3 * source_size * open_weight_ AS full_,
         CASE WHEN full_ THEN (3 * source_size)::DOUBLE
              ELSE (weight * level.words)::DOUBLE / open_weight_::DOUBLE END AS target,
         CASE WHEN full_ THEN 3 * source_size ELSE weight * level.words // open_weight_ END AS target_words
  FROM s, (SELECT words, open_weight AS open_weight_ FROM level) AS level),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN target_words // source_size ELSE 0 END AS repeats,
         target_words - repeats * source_size AS lack FROM t),
c AS (
  SELECT source, place, sum(size)::HUGEINT AS words,
         (sum(sum(size)) OVER (PARTITION BY source ORDER BY place))::HUGEINT - sum(size)::HUGEINT AS under
  FROM d GROUP BY source, place)
SELECT d.doc_id, d.size, u.source_size::BIGINT AS source_size, u.target,
       (d.size * (u.repeats + CASE WHEN u.lack > 0 AND c.under + c.words <= u.lack THEN 1 ELSE 0 END)
        + CASE WHEN u.lack > 0 AND c.under <= u.lack AND c.under + c.words > u.lack
               THEN d.size * (u.lack - c.under) // c.words ELSE 0 END)::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
