"""Outage hours over a stream of events: each micro-batch updates the stored intervals of the roads that it touches.

Merged intervals are not a windowed aggregate (a late event may join two islands), so the state is a table of events keyed by road:
a micro-batch is added to it, idempotently by its number, and the hours are recomputed for the touched roads only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfault.operators.intervals import EDGE, hours_by_category

KEPT = [*EDGE, "event_id", "start_ts", "end_ts", "closed", "flooded", "repairs"]


def update(batch: DataFrame, number: int, state: str, results: str) -> None:
    """Add a micro-batch of collected events to the state, and write the hours of its roads under the batch's number."""
    batch.select(*KEPT).write.mode("overwrite").parquet(f"{state}/batch={number}")
    spark = batch.sparkSession
    known = spark.read.parquet(state).where(F.col("batch") <= number).select(*KEPT)
    touched = known.join(batch.select(*EDGE).distinct(), EDGE, "left_semi")
    hours_by_category(touched).write.mode("overwrite").parquet(f"{results}/batch={number}")


def latest(results: DataFrame) -> DataFrame:
    """The last hours of each road from the results of all batches (column ``batch``)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*EDGE).orderBy(F.desc("batch"))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def start(stream: DataFrame, state: str, results: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, n: update(df, n, state, results)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
