"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

Defined cases, for every stage: null and empty texts are documents like others
(no shingles, no words: they are kept but by mixing, which takes a document
without words zero times); null ids are kept, and near-dedup takes the rows of
one id, or of none, as one document; repeated rows are judged alike, and
near-dedup keeps one of them; very long texts are taken whole; other columns stay
as they are, whatever their names, and so does an empty table. Of equal documents
the one with the smallest id stays, of equal ids that with the smallest text hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, mixing, neardup, sharding, toxicity
from lodestone.llm.common import stage


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.toxic_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return neardup.near_dedup(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each epoch in which a document is taken."""
    return mixing.mix_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus with size, shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_unleaked),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Model fitting and near-duplicate search can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
