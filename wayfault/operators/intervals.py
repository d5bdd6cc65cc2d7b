"""Time intervals per key: islands of overlapping intervals, outage hours, and hours by category.

Everything is one window sort and two aggregations on the same key; Spark keeps the partitioning between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfault.functions.scalars import closed_road, event_end, relevant_event

EDGE = ["u", "v", "key"]


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``df`` with ``island_id``: intervals that overlap or touch share one within their key; unknown ends come last."""
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the first interval of a key always begins an island of its own kind, as nothing ends before it
    begins = F.when(F.col(start) > F.coalesce(F.max(end).over(before), F.lit("1970-01-01").cast("timestamp_ntz")), 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn("island_id", F.sum("_begins").over(so_far)).drop("_begins")


def running_end(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, start, running_end``: the latest end of all intervals that have begun by each start."""
    order = Window.partitionBy(*keys).orderBy(start)  # rows with the same start see each other
    return df.select(*keys, start, F.max(end).over(order).alias("running_end")).distinct()


def previous_end(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, start, previous_end, begins``: the latest end of intervals that begin earlier, and whether an island begins and ends nothing else at that start."""
    at = df.groupBy(*keys, start).agg(F.max(end).alias("_end"), F.count(F.lit(1)).alias("_n"), F.count(end).alias("_known"))
    earlier = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    out = at.withColumn("previous_end", F.coalesce(F.max("_end").over(earlier), F.lit("1970-01-01").cast("timestamp_ntz")))
    alone = (F.col("_n") == 1) | (F.col("_known") == 0)
    return out.select(*keys, start, "previous_end", ((F.col(start) > F.col("previous_end")) & alone).cast("int").alias("begins"))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, id_: str) -> DataFrame:
    """``keys, island_id, ids, merged_start, merged_end``, only islands that last."""
    out = islands(df, keys, start, end).groupBy(*keys, "island_id").agg(F.collect_list(id_).alias("ids"), F.min(start).alias("merged_start"), F.max(end).alias("merged_end"))
    return out.where("merged_end > merged_start")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def outage_hours(df: DataFrame, keys: list[str], start: str, end: str, id_: str) -> DataFrame:
    """``keys, ids, n_intervals, hours``: merged intervals of each key; ids sorted, not made distinct."""
    merged = merged_intervals(df.select(*keys, id_, start, end).distinct(), keys, start, end, id_)
    return merged.groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"), F.count(F.lit(1)).alias("n_intervals"),
        F.round(F.sum(seconds_between(F.col("merged_start"), F.col("merged_end"))) / 3600.0, 2).alias("hours"),
    )


def collected_events(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Relevant events of each road, with their interval and categories.

    ``pairs``: ``u, v, key, event_id``; ``events``: ``event_id, start_date_time, event_interval, estimated_duration_mins, lanes_detail,
    lanes_status, sub_category, description``.
    """
    e = events.where(relevant_event(F.col("sub_category"), F.col("description")))
    e = e.select(
        "event_id", F.col("start_date_time").alias("start_ts"), event_end(F.col("start_date_time"), F.col("event_interval"), F.col("estimated_duration_mins")).alias("end_ts"),
        closed_road(F.col("lanes_detail"), F.col("lanes_status")).alias("closed"), (F.upper("sub_category") == "WEATHER HAZARD").alias("flooded"),
        F.upper("sub_category").isin("CONSTRUCTION", "MAINTENANCE").alias("repairs"),
    )
    return pairs.select(*EDGE, "event_id").join(e, "event_id")


CATEGORIES = {"road_closed": "closed", "road_flooded": "flooded", "road_repairs": "repairs"}


def hours_by_category(collected: DataFrame) -> DataFrame:
    """Counts, hours and ids of all events of each road, and of those that closed, flooded or repaired it.

    An event is listed under each of its categories, and rows are dealt by road once: the distinct rows, islands, and sums of all categories need no other exchange.
    """
    kinds = F.array(F.lit("all"), *[F.when(F.col(flag), F.lit(name)) for name, flag in CATEGORIES.items()])
    dealt = collected.select(*EDGE, "event_id", "start_ts", "end_ts", F.array_compact(kinds).alias("_kinds")).repartition(*EDGE)
    rows = dealt.select(*EDGE, F.explode("_kinds").alias("_kind"), "event_id", "start_ts", "end_ts")
    each = outage_hours(rows, [*EDGE, "_kind"], "start_ts", "end_ts", "event_id")
    own = lambda name, c: F.first(F.when(F.col("_kind") == name, F.col(c)), ignorenulls=True)
    none = F.array().cast("array<string>")
    columns = []
    for name in ("all", *CATEGORIES):
        columns += [F.coalesce(own(name, "ids"), none).alias(f"{name}_events_ids"), F.coalesce(own(name, "n_intervals"), F.lit(0)).alias(f"{name}_incidents_count"), F.coalesce(own(name, "hours"), F.lit(0.0)).alias(f"{name}_total_duration_hours")]
    return each.groupBy(*EDGE).agg(*columns)
