"""One registered query per corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import exact, language_id, lattice_lm, manifest, mixing, packing, periods, quality, repeats, simhash, token_files, vectors, windows
from gleanworks.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.held_out_languages(_table(spark, folder, "documents"))


@_query("op2_token_files")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_index(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op3_lattice_scores")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = _table(spark, folder, "documents"), language_id.fold(2, 7)
    learn = F.col("doc_id").isNotNull() & ~held_out
    return lattice_lm.score_texts(docs, learn, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language_id.fold(0, 5)
    learn = F.col("doc_id").isNotNull() & ~held_out
    scored = quality.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"), learn)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query("op5_pack_sequences")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op6_remove_repeats")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents"))


@_query("op7_simhash_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query("op8_vector_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, folder, "embeddings"))


@_query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


@_query("op10_exact_dedup", exact.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, folder, "documents"))


@_query("op11_shared_windows", windows.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return windows.without_shared_windows(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")


@_query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.planted_periods(_table(spark, folder, "documents"))))


@_query("op13_merkle_manifest", manifest.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(_table(spark, folder, "documents"), shown=manifest.tampered_leaf())
