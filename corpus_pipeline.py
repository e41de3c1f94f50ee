"""A training corpus from raw documents: rejected, deduplicated, decontaminated, mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipwright.llm import decontam, mixing, quality, sharding, simhash
from clipwright.llm.common import rewritten, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learned from `labels`, doesn't reject; a table without labels keeps all."""
    return quality.keep_good(docs, quality.score_quality(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose distinct 5-word shingles have a Jaccard similarity of 0.8 or more, by links."""
    return simhash.keep_first(docs, simhash.near_copies(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold less than 0.8 of the shingles of every item of `benchmark`."""
    return decontam.drop_contaminated(docs, decontam.find_contained(docs, table(spark, sf_dir, "benchmark")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources at their target weights, complete epochs before a drawn part. Prose is drawn before text full of signs."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def rendezvous_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest: shard, slot and shard among one more for each document. Nulls and very long texts in any stage are kept or go by their content, like other texts."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("rendezvous_sharding", rendezvous_sharding),
]

#: The classifier is fitted and SimHash needs XXH64, so SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else rewritten(docs), sf_dir)
    return docs
