"""A training-corpus pipeline of five stages, each written and read again by its successor.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  The first four return the columns
of ``documents``; the last packs what is left into sequences.  ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfault.llm import exact_dedup, near_copies, packing, quality_rules, toxicity
from wayfault.llm.common import remove, scratch_path, scratch_scope


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays: SimHash on five-word shingles, decided at a similarity of 0.8."""
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: Learned models and tokenizer ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way is deleted when its result is written, and so is its input."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        written = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(written)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(written), written
    return STAGES[-1][1](spark, docs, sf_dir)
