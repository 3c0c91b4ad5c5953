"""Documents to training sequences: filter, deduplicate, decontaminate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeloom.llm import decontaminate, minhash, packing, quality, suffixes
from lodeloom.llm.store import Scratch


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; it learns from the labels of the documents it gets."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return minhash.keep_one_of_each(spark, docs, shingle=5, percent=80)


def _repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur earlier in the corpus."""
    return suffixes.remove_repeats(spark, docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.best_two_fit(spark, docs, 2048)


STAGES = [
    ("quality_classifier", _quality),
    ("minhash_near_dedup", _near_duplicates),
    ("suffix_array_dedup", _repeated_passages),
    ("benchmark_decontamination", _decontaminate),
    ("best_fit_packing", _pack),
]

#: The tokenizer and the trained classifier cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
