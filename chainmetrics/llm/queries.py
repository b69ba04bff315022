"""The registered queries of the operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, pii, secrets
from .columns import repeated_substrings
from .compact import passages
from .minhash import near_duplicates
from .packing import pack
from .partenum import jaccard_components
from .quality import quality_scores
from .repair import repair_digests
from .tiff import media_digests
from .tokens import token_counts
from .trie import prefix_trie
from .winnow import contamination


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(table(spark, sf_dir, "documents"), words=50, percent=80, all_links=False)
    text = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_words", "component_id", F.size("passages").cast("long").alias("n_passages"), "n_repeated", text.alias("passages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"), length=200).drop("spans")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), **pii.EVIDENCE))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(table(spark, sf_dir, "conversations"))


def op12_partenum_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_winnowing_decontamination": op2_winnowing_decontamination,
    "op3_tiff_media": op3_tiff_media,
    "op4_token_counts": op4_token_counts,
    "op5_hilbert_packing": op5_hilbert_packing,
    "op6_compact_windows": op6_compact_windows,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_pii_sanitisation": op10_pii_sanitisation,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_partenum_jaccard_join": op12_partenum_jaccard_join,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
