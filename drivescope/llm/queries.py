"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivescope.llm import sql
from drivescope.llm.bitslice import top_k
from drivescope.llm.bpe import bpe_encode
from drivescope.llm.edits import edited_likeness
from drivescope.llm.frames import id_and_text, table
from drivescope.llm.hadamard import cluster
from drivescope.llm.hilbert import hilbert_shards
from drivescope.llm.idcoder import read_id_files, write_id_files
from drivescope.llm.infill import fill_in_middle, restored
from drivescope.llm.licenses import scan_licenses
from drivescope.llm.minmax import near_duplicates
from drivescope.llm.mixing import mix, sized
from drivescope.llm.prefixes import count_tokens
from drivescope.llm.quality import CUT_SCORE, ranked_documents
from drivescope.llm.repeats import without_repeats
from drivescope.llm.simhash import with_near_counts
from drivescope.operators.staging import materialize, staging_path


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode=True)
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.encode(F.col("k").cast("string"), "UTF-8")) % 5
    ranked = ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=remainder != 0)
    held = F.crc32(F.encode(F.coalesce(F.col("id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0
    return ranked.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"), "quantile")


def op3_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    keys = id_and_text(docs, lang="lang", source="source").select(
        "id", "lang", "source", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    placed = hilbert_shards(keys, ["source", "lang", "size"], ["crc", "id"], shards=40)
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = materialize(edited_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("fingerprint", "shown"), "likeness")
    counted = with_near_counts(shown.withColumn("fingerprint", F.conv("shown", 16, -10).cast("long")), radius=3, blocks=5)
    return counted.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.col("shown").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "n_near", "n_equal")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"), min_words=35)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "ids")
    write_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    return read_id_files(spark, path, _checksum, "ids_crc32").withColumnRenamed("id", "doc_id")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)
    return found.withColumnRenamed("id", "vec_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = 4096
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=limit)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars", "kept_chars")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_share=80)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, seed=3)[0].withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_quality, op3_minmax, op4_hilbert_shards, op5_simhash, op6_repeats, op7_id_files, op8_top_k, op9_license_scan, op10_mix,
                             op11_prefix_counts, op12_infill, op13_hadamard_clusters)
}

ORACLES: dict[str, str] = {"op3_minmax": sql.NEAR_DUPLICATES, "op6_repeats": sql.REPEATS, "op8_top_k": sql.TOP_K,
                            "op12_infill": sql.INFILL, "op13_hadamard_clusters": sql.clusters(rounds=10, k=8)}
