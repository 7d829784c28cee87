"""The numbered queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, flac, huffman, mixing, packing, quality, simhash, substrings, toxicity
from .oracle import ORACLE_SQL
from .scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.describe(written(flac.store(_table(spark, sf_dir, "documents")), "flac"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, lengths = huffman.store(_table(spark, sf_dir, "documents"), _tokenizer(), end=0)
    return huffman.read_blocks(blocks, lengths).select("doc_id", "start", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(_table(spark, sf_dir, "documents"))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(), end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_huffman_ids": op2_huffman_ids,
    "op3_sainte_lague_mix": op3_sainte_lague_mix,
    "op4_simhash_variants": op4_simhash_variants,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_pu_quality": op6_pu_quality,
    "op7_compact_windows": op7_compact_windows,
    "op8_chat_snapshots": op8_chat_snapshots,
    "op9_one_permutation_minhash": op9_one_permutation_minhash,
    "op10_harmonic_packing": op10_harmonic_packing,
}