"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing to target weights, sharding.

Each stage takes any columns beside doc_id, text and source and gives them back; those of the last stage that have the
name of an added column (shard, slot) are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrain.llm import decontaminate, mixing, quality, shards, simhash
from lexgrain.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a text without the common words of any language goes.

    Null, empty and very short texts go; each row is judged for itself, so repeated rows share their fate.
    """
    return quality.keep_good(docs, limits=quality.WORDS_DECIDE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays, of repeated rows one; texts without words are copies of each other.
    """
    return simhash.drop_near_duplicates(docs, **simhash.SIMILAR_TEXTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; an empty benchmark keeps every row."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, in a global random order; a null source is one of its own."""
    return mixing.mix(docs, power=0.5, seed=17).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot, in 16 shards of near-equal bytes; a null text weighs one byte, ties go by id."""
    return shards.shard(docs, n_shards=16)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("source mixing", source_mixing), ("sharding", sharding)]

#: Fingerprints, alignment and hashed draws are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
