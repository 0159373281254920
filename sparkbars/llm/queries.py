"""One registered query per operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunks import shared_passages
from .common import table
from .decontam import contamination
from .lang_id import identify
from .licences import licences
from .mixing import mix, taken
from .near_dup import near_duplicates
from .negatives import hard_negatives, relabelled
from .neighbours import nearest_of_every
from .packing import pack
from .pii import digest, find_spans
from .prefix_trie import prefix_trie
from .quality import quality
from .suffixes import repeated_strings


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents")).drop("kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_spans(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_of_every(table(spark, sf_dir, "embeddings"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_licence_scan, op2_suffix_array_dedup, op3_substring_dedup, op4_quality_classifier, op5_language_id, op6_personal_data, op7_best_fit_packing,
             op8_minhash_near_dedup, op9_nearest_neighbours, op10_benchmark_decontamination, op11_conversation_prefix_trie, op12_hard_negatives,
             op13_source_mixing)
    return {f.__name__: f for f in found}
