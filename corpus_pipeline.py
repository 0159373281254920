"""A training-data pipeline over documents: each stage works on all that the one before kept.

In every stage but the last, rows are kept or left out whole, with the columns that came in, whatever other columns there are;
an empty table gives an empty one. What happens to null ids, null texts and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.llm.common import Scratch, table
from sparkbars.llm.decontam import decontaminate
from sparkbars.llm.lang_id import identifiable
from sparkbars.llm.near_dup import deduplicate
from sparkbars.llm.packing import pack
from sparkbars.llm.pii import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows of no identifiable language: null texts and texts without a letter. Each row is judged by its own text, so rows
    that repeat an id may fare differently, and rows without an id are judged like others."""
    return identifiable(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates. Rows without id or words stay; rows that repeat an id stay or go together."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item. Rows without id or text stay; rows that repeat an id go if one of them contains an item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars becomes the new length, null for a null text. Each row is treated by itself."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 1024 tokens; the last stage returns pieces. Each row is packed, a null text as the end id alone."""
    return pack(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data),
          ("packing", packing)]
ORACLE_SQL = None  # tokens, trained models and sketches are beyond SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage keeps is a table in the shared folder until the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
