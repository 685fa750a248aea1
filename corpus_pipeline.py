"""Training corpus: quality rules, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read as the next one's
docs. All but the last return the columns of documents. Nulls, empty and very long texts, ties, repeated rows, empty
tables and further columns have the results that the operators' docstrings define; repeated rows stay apart rows in
all stages but near_duplicates, which keeps one row of an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm import decontaminate, jaccard, mixing, quality, sharding
from foldlake.llm.common import materialize, scratch_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy, out of a ledger stored with its rows."""
    return quality.keep(quality.store(docs, scratch_path(spark, "ledger")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more. The ledger of the stage before goes first,
    unless docs still reads it."""
    quality.drop_stored(docs)
    return jaccard.keep_one(docs, n=5, num=4, den=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in 16 shuffled shards: the columns of documents, shard and slot."""
    return sharding.shard(docs).select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: The shuffle draws its communication matrix, which SQL can't. tests/llm/test_pipeline.py holds each stage against a
#: plain version of it on a small table with null, repeated, empty and copied rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
