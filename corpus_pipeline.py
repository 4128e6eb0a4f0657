"""A training corpus from raw documents: reject toxic ones, keep one of each near-duplicate class, remove benchmark
leaks, mix the sources, and deal the result over shuffled shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  Empty tables give empty
results; null and empty texts pass the first three stages, and have no words that the mix could take; extra columns are
carried along, and a column that would clash with one that the last stage adds keeps its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, mixing, near_dup, sharding, toxicity
from trackloom.llm.store import removed, settled


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go; repeated rows, null texts and null ids are rows like others."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, the one of the smallest doc_id; rows equal in doc_id and text
    are one.  Blank texts are in no class; so are rows without a doc_id, but for those equal in text."""
    # bands of 6 samples: a pair at the limit misses all 49 with a chance of 1 in 3 million
    return near_dup.distinct_documents(docs, (80, 100), bands=49, rows=6)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of the benchmark go; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights: a row is taken not at all, once or twice.  A null source is one of its own."""
    return mixing.mixed_documents(docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets a shard, by its doc_id alone, and a slot; rows without one share a shard."""
    return sharding.sharded_documents(docs)


STAGES = [("toxicity", _toxicity), ("near_dup", _near_dup), ("decontaminate", _decontaminate), ("mixing", _mixing), ("sharding", _sharding)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the corpus of ``sf_dir``: the columns of documents, shard and slot.

    Each stage's result is written and read again, and what its operators wrote on the way is removed; so is the result of
    the stage before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, folder = settled(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)
        before = folder
    return docs
