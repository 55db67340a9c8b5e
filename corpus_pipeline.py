"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes what the one before kept, as a Parquet table in the shared folder. The first four return the columns of
``documents``: toxicity drops rows, near-duplicate removal keeps the smallest id of each component (five-word shingles,
80 of 100), substring deduplication cuts repeated passages of at least 50 words out of all but their first document,
and decontamination drops documents that hold a benchmark item. The last one packs the words of what is left into
sequences; it returns a row per piece: doc_id, piece, n_tokens, bin_id, bin_capacity, bin_offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.decontaminate import without_leaks
from inkspark.llm.near_dedup import without_near_duplicates
from inkspark.llm.packing import pack, word_count
from inkspark.llm.store import source, written
from inkspark.llm.substring_dedup import without_passages
from inkspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return without_near_duplicates(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; ``n_chars`` follows the text."""
    out = without_passages(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in out.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences."""
    return pack(docs, word_count(F.col("text")))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages are learned, iterative or sequential: SQL can't express their rows. ``tests/llm/test_stages.py`` holds ``run`` against
#: plain Python over a table with nulls, repeats, empty and long texts and clashing columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
