"""Registered queries of the dealt operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import licenses, mixing, neardup, packing, passages, periods, pfor, quality, streamdedup, tokencounts, topk, turns, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pfor.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return pfor.read_token_files(files)


def op2_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", *quality.STATS, "base_failed", "kept", "distance")


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    pages = found.where("gap IS NULL AND record_type IN ('response', 'revisit')")
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("_text")


def op8_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op10_unigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op12_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(periods.with_periods(table(spark, sf_dir, "documents")), digest=True)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("_best", longest).withColumn("length", -F.col("_best.length"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), "length", F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("length") / F.col("_best.period")).alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def op13_rank_convergence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired_after_damage(table(spark, sf_dir, "conversations"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    chosen = (
        op1_pfor_token_files,
        op2_covariance_outliers,
        op3_license_sentences,
        op4_exact_complement_packing,
        op5_warc_salvage,
        op6_dual_cover_tree,
        op7_lsh_forest,
        op8_low_discrepancy_mix,
        op9_suffix_dedup,
        op10_unigram_trie,
        op11_streaming_exact_dedup,
        op12_tiled_runs,
        op13_rank_convergence_repair,
    )
    return {f.__name__: f for f in chosen}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_sentences": licenses.sql(),
        "op5_warc_salvage": warc.SQL,
        "op6_dual_cover_tree": topk.SQL,
        "op8_low_discrepancy_mix": mixing.SQL,
        "op11_streaming_exact_dedup": streamdedup.SQL,
    }
