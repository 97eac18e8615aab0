"""Registered queries of the operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import (
    decontamination, edit_embedding, fill_in_middle, hard_negatives, language_id, license_scan, line_dedup, near_dedup, oracle, piece_coding, quality_rules, sharding,
    suffix_dedup, toxicity,
)
from ._util import read


def op1_run_length_dedup(spark, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_gone").alias("n_removed"), "text")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "stratum")


def op8_piece_coding(spark, sf_dir: str) -> DataFrame:
    coded = piece_coding.encode(read(spark, sf_dir, "documents"), verify=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = sharding.shard_rows(rows, ["doc_id", "text_crc32", "size"], shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op11_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_embedding.compare_with_next(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored, 256).alias("restored_sha256"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    "op1_run_length_dedup": op1_run_length_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_minmax_near_dedup": op4_minmax_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_piece_coding": op8_piece_coding,
    "op9_feistel_shards": op9_feistel_shards,
    "op10_license_scan": op10_license_scan,
    "op11_edit_fingerprints": op11_edit_fingerprints,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_minmax_near_dedup": oracle.near_dedup_sql(),
    "op5_line_dedup": oracle.line_dedup_sql(),
    "op7_quality_rules": oracle.quality_sql(),
    "op12_fill_in_middle": oracle.fill_in_middle_sql(),
    "op13_hard_negatives": oracle.hard_negatives_sql(),
}
