"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, byte_cnn, chat, cross_tokens, line_dedup, lm, mixing, packing, quality_rules, simhash, substrings, toxicity, turn_repair
from quire.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line deduplication: text, and what it lost."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed", "words_removed")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recovered turns of every conversation, written as a transcript, in canonical form."""
    turns = table(spark, sf_dir, "conversations")
    spelt = chat.transcripts(turns)
    return chat.format_chat(spelt, chat.fit(spelt)).select("conv_id", "block", "place", "role", "rendered")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in order of first training position."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position")
    rows = found.select("doc_id", "size", "source_size", "target", "taken", "copies", F.size("positions").alias("epochs"), first)
    order = [F.col("first_position").asc_nulls_last(), "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def piece_digests(docs: DataFrame) -> DataFrame:
    """The pieces of the packed sequences, ids as their checksum."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return piece_digests(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.score(docs, net).select("doc_id", "held_out", "score", "predicted")


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two vocabularies that cover the same bytes in every document, and how common their links are."""
    found = cross_tokens.cross_alignment(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by hash, with its faults and the cheapest repair."""
    return turn_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after removal of the strings of 50 bytes that an earlier one holds too."""
    found = substrings.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_nearest": op7_nearest,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_cross_tokens": op11_cross_tokens,
    "op12_turn_repair": op12_turn_repair,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: The mix in closed form: the level is the first at which the next source's cap per weight is no lower.
OP5_SQL = r"""WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) END AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM sums),
weighed AS (SELECT *, [1.0, 2.0, 3.0][(place - 1) % 3 + 1]::DOUBLE AS weight, [1.5, 1.0, 0.5][(place - 1) % 3 + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][(place - 1) % 3 + 1]::DOUBLE AS b, source_size * 3.0::DOUBLE AS cap FROM placed),
laid AS (SELECT *, cap / weight AS full_at, coalesce(sum(cap) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free, sum(source_size) OVER () AS total
  FROM weighed WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(max((total - capped) / free) FILTER ((total - capped) / free <= full_at), 0) AS level FROM laid),
plan AS (SELECT source, source_size, a, b, least(weight * level, cap) AS target, CAST(floor(least(weight * level, cap)) AS BIGINT) AS whole FROM weighed, level),
run AS (SELECT s.doc_id, s.size, s.h, p.*, CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE whole // source_size END AS rounds, CASE WHEN source_size = 0 THEN 0 ELSE whole % source_size END AS rest FROM run),
out AS (SELECT *, greatest(0, least(size, rest - ahead)) AS part, CASE WHEN size > 0 THEN rounds + CAST(ahead < rest AS INTEGER) WHEN source_size = 0 THEN 1 ELSE rounds + CAST(ahead <= rest AS INTEGER) END AS epochs, least(1.0, ahead / greatest(target, 1.0)) AS share FROM parts)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(rounds * size + part AS BIGINT) AS taken,
  CAST(CASE WHEN size = 0 THEN least(epochs, 1) ELSE rounds + CAST(2 * part >= size AS INTEGER) END AS INTEGER) AS copies, CAST(epochs AS INTEGER) AS epochs,
  CASE WHEN epochs > 0 THEN 0.0 + round(CASE WHEN a = b THEN share ELSE (-a + sqrt(a * a + 4 * ((b - a) / 2) * share * ((a + b) / 2))) / (2 * ((b - a) / 2)) END, 9) END AS first_position FROM out"""

SQL: dict[str, str] = {"op5_mixing": OP5_SQL}
