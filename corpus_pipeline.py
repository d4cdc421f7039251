"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import small_batches
from helixframe.llm.decontaminate import without_leaks
from helixframe.llm.near_dups import without_near_duplicates
from helixframe.llm.packing import pack
from helixframe.llm.quality import fit_quality, keep_quality
from helixframe.llm.suffixes import without_repeats
from helixframe.session import discard, scratch, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant, learned from the labels outside the held-out fold, does not reject."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of every group of near duplicates (80 percent of five-word shingles)."""
    return without_near_duplicates(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes in 50-byte strings that also start in a document with a smaller id."""
    return without_repeats(docs, length=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 to 16384 bytes."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can't express MinHash candidates, suffix merges or the classifier's fit; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; of the tables that they store only the last one's result is left."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark), small_batches(spark):
            kept = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        for path in {p.rpartition("/")[0] for p in docs.inputFiles()} if i else ():
            discard(spark, path)
        docs = kept
    return docs
