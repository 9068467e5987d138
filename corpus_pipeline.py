"""A training-data pipeline of five of the llm operators, each stage written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, mixing, omh_dedup, sharding, toxicity
from gridloom.llm._shared import discard, scratch_path, table


# Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and further
# columns (names that begin with two underscores are reserved); what each does with them is said below.


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without what the classifier calls toxic. Null and empty texts stay; repeated rows go or stay together; null ids are not learned from."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near copies: the least id; of repeated rows one; a null id only where the class has no other. Null texts stay; empty texts are copies."""
    return omh_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that leak a benchmark item. Null and empty texts stay; repeated rows go or stay together; an empty benchmark rejects none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate says. A null source is a source; empty texts weigh 0; repeated rows draw alike; a null id draws by its text."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot. Repeated rows and equal texts are linked, null texts are not; null ids are dealt like others."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The classifier and the alignments cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and its input is deleted then."""
    docs, staged = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(*staged)
        docs = spark.read.parquet(path)
        staged = [docs]
    return docs
