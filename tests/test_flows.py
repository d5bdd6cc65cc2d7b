"""Whole flows over a small town, the stream of events, and the command line."""

import pytest
from pyspark.sql import functions as F

from wayfault import cli
from wayfault.operators import intervals
from wayfault.operators.spatial_join import polygon_literal
from wayfault.plans import pipelines, registry
from wayfault.streaming import outages

D = 0.001


@pytest.fixture(scope="module")
def town(spark):
    """A square of streets with a bridge on one side, a through road, and a dead end."""
    nodes = [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 2, 1), (5, 2, 2), (6, 1, 2), (7, 0, 2), (8, 0, 1), (9, 3, 1)]
    ways = [
        (10, [1, 2, 3], False, "primary", None, "US 1", "Main", None), (11, [3, 4], False, "secondary", None, None, "East", None), (12, [4, 5], False, "secondary", None, None, "East", "yes"),
        (13, [5, 6, 7], False, "residential", None, None, "North", None), (14, [7, 8, 1], False, "residential", None, None, "West", None), (15, [4, 9], False, "service", "driveway", None, None, None),
    ]
    n = spark.createDataFrame([(i, x * D, y * D) for i, x, y in nodes], "node_id long, x double, y double")
    w = spark.createDataFrame([(*r, None, None, None) for r in ways], "osmid long, node_ids array<bigint>, oneway boolean, highway string, service string, ref string, name string, bridge string, tunnel string, surface string, maxspeed string")
    return pipelines.base_network(w, n)


def test_network(town):
    rows = town.edges.collect()
    got = {(r.u, r.v): r for r in rows}
    assert sorted((r.u, r.v, r.key) for r in rows) == [(4, 4, 0), (4, 4, 1), (4, 9, 0), (9, 4, 0)]  # both ways round, and the dead end
    assert sum(r.length for r in rows) == pytest.approx(town.base.agg(F.sum("length")).first()[0])
    assert got[4, 9].roadclass == 8 and got[4, 9].speed_kph == 30


def test_flows(town, spark):
    red = pipelines.redundancy(town)
    assert red.count() == town.edges.where("roadclass BETWEEN 0 AND 4").count()
    plain = spark.range(1).select(polygon_literal([[(1.5 * D, -D), (2.5 * D, -D), (2.5 * D, 0.5 * D), (1.5 * D, 0.5 * D), (1.5 * D, -D)]]).alias("polygon")).withColumn("floodplain_idx", F.lit(1)).withColumn("flood_risk_level", F.lit(13))
    flood = pipelines.flood_impact(town, plain)
    assert {r.nonfunctional_reason for r in flood.collect()} >= {"FLOODED"} and flood.count() == town.edges.count()
    nodes, edges = pipelines.network_centrality(town)
    assert edges.count() == town.edges.count() and nodes.count() == 2
    events = spark.sql(f"SELECT '7' AS event_id, {D} AS x, 0.00002 AS y, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS start_date_time, CAST(NULL AS STRING) AS event_interval, 90.0D AS estimated_duration_mins, 'all lanes' AS lanes_detail, 'closed' AS lanes_status, 'weather hazard' AS sub_category, 'rain' AS description")
    hours = pipelines.event_hours(town, events, D, D)
    assert {(r.all_total_duration_hours, r.road_flooded_incidents_count, r.road_repairs_incidents_count) for r in hours.collect()} == {(1.5, 1, 0)}
    fused, simple = pipelines.fused(town, {"redundancy": red.select("u", "v", "key", "difference_sec"), "flood": flood, "centrality": edges, "events": hours})
    assert fused.count() == simple.count() == town.edges.count() and sorted(r._id_ for r in fused.collect()) == list(range(1, town.edges.count() + 1))


def test_stream_equals_batch(spark, sf, tmp_path):
    from wayfault.plans.events_queries import collected

    rows = collected(registry.Data(spark, sf)).select(*outages.KEPT)
    for i in range(3):
        rows.where(F.crc32("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    outages.start(stream, f"{tmp_path}/state", f"{tmp_path}/results", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = outages.latest(spark.read.parquet(f"{tmp_path}/results"))
    want = intervals.hours_by_category(rows)
    assert sorted(map(str, got.select(*sorted(want.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def test_command_line(spark, sf, tmp_path, capsys):
    cli.main(["query", "a2_outage_hours", sf, "--out", str(tmp_path)])
    assert spark.read.parquet(f"{tmp_path}/a2_outage_hours").count() > 0 and "a2_outage_hours" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["flow", "nothing", sf])
