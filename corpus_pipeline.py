"""From raw documents to a mixed and sharded training corpus, stage by stage.

Each stage gets what its predecessor kept and returns a DataFrame, which is written as Parquet and read again;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, language_id, minhash_dedup, mixing, sharding
from siltstone.llm.shared import read, stored

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (nearest centroid, close enough); a missing lang is filled in.

    Null and empty texts and texts without a letter are rejected, and so is everything if no row has a lang. Very long texts are
    judged whole; repeated rows are kept or dropped together; ties go to the first language by code point; columns of any
    name stay as they are; an empty table stays empty."""
    model = language_id.fit(docs)
    found = language_id.language_id(docs.select(F.struct("*").alias("row"), "text"), model).where("NOT rejected")
    column = lambda c: F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`")
    return found.select(*[column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of five-word shingles: that with the least id.

    Documents without words are kept, and so are those with a null id; a document under five words is one shingle; rows with equal
    ids are one document, kept or dropped together; very long texts are compared whole; columns of any name stay."""
    return minhash_dedup.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item.

    Null and empty texts hold none; an item under ten words is one run; rows with equal ids but other texts are judged each by
    its own text; an empty benchmark drops nothing; columns of any name stay."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants, three times at most.

    Documents without words are taken no time; a null source is a source of its own, last in order; the one document of a source
    that is wanted in part is taken whole if half of it or more is wanted; reruns agree; columns of any name stay."""
    return mixing.mixing(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size and shard (in place of columns of these names); shards hold near equal bytes, equal texts share one.

    Null texts are one group and empty texts another; a group larger than a shard's share has its shard alone; repeated rows
    stay rows; an empty table stays empty."""
    return sharding.sharding(docs.withColumn("size", sharding.size_of(F.col("text"))), SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: MinHash and centroids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
