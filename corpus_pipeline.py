"""The training-data pipeline: documents through five of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanframe.llm import decontaminate, langid, minhash, mixing, sharding
from cleanframe.llm.store import stored

N_SHARDS = 40

#: SQL has none of the operators whose decisions the rows depend on; tests rebuild them by brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their own labelled part teaches; others go."""
    return langid.accepted(docs, langid.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return minhash.deduplicated(docs)


def unspoiled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [
    ("language ID", identified),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", unspoiled),
    ("mixing sources to target weights", mixed),
    ("sharding", in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
