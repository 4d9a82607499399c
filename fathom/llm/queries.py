"""The registered queries of the training-data operators: each over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, huffman, licenses, near_copies, packing, quality, recompression, shared, suffixes, templates, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), shared.hex_digest(names).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.dedup_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_dropped", shared.hex_digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_files(huffman.write_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op7_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_recompression, op3_lsh_forest, op4_line_templates, op5_packing, op6_token_files, op7_line_first, op8_suffix_array, op9_counterfactual, op10_license_digests)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_templates": templates.ORACLE_SQL, "op7_line_first": quality.ORACLE_SQL, "op10_license_digests": licenses.oracle_sql()}
