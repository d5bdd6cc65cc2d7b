"""What operators write on their way can be deleted, and is, between the stages of the pipeline."""

import os

import corpus_pipeline
from wayfault.llm import exact_dedup
from wayfault.llm.common import scratch_scope, settings


def listed(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/", 1)
    return {x for x in os.listdir(folder) if x.startswith("wayfault-")}


def test_scope(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string")
    before = listed(spark)
    with scratch_scope(spark):
        exact_dedup.keep_distinct(df).write.parquet(f"{tmp_path}/kept")
        assert listed(spark) > before
    assert listed(spark) == before and spark.read.parquet(f"{tmp_path}/kept").count() == 3


def test_pipeline_leaves_the_last_stages_tables_only(spark, sf):
    before = listed(spark)
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and len(listed(spark) - before) <= 3


def test_settings_are_restored(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == old
