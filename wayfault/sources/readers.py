"""Sources: road extracts, hazard layers, inventories and events as tables; a cache keyed by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfault.functions import geometry as G
from wayfault.functions.exact_geometry import ellipsoid_distance
from wayfault.functions.scalars import county_code
from wayfault.operators.flood import require_ranks

#: Highway tags of a regional extract, major and minor.
MAJOR_HIGHWAYS = ["motorway", "motorway_link", "motorway_junction", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]
MINOR_HIGHWAYS = ["residential", "living_street", "unclassified"]


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null, once, at the source."""
    return df.select(*[F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")).alias(n) if k in ("float", "double") else F.col(f"`{n}`") for n, k in df.dtypes])


def network(spark: SparkSession, folder: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed base edges of ``folder`` (``nodes``, ``base_edges`` in Parquet), within a bounding box."""
    nodes, edges = without_nan(spark.read.parquet(f"{folder}/nodes")), without_nan(spark.read.parquet(f"{folder}/base_edges"))
    if box:
        nodes = nodes.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
        edges = edges.join(nodes.select(F.col("node_id").alias("u")), "u", "left_semi").join(nodes.select(F.col("node_id").alias("v")), "v", "left_semi")
    return nodes, edges


def base_edges(ways: DataFrame, nodes: DataFrame, ellipsoid: bool = False) -> DataFrame:
    """Directed edges between consecutive nodes of ways (``osmid, node_ids, oneway`` and tags), with spherical or ellipsoidal lengths."""
    n = F.size("node_ids")
    pairs = F.transform(F.slice("node_ids", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, i: F.struct(a.alias("u"), F.get("node_ids", i + 1).alias("v")))
    rows = ways.select(*[c for c in ways.columns if c not in ("node_ids", "oneway")], F.coalesce("oneway", F.lit(False)).alias("_one"), F.explode(pairs).alias("_p"))
    both = rows.select(*[c for c in rows.columns if c not in ("_p", "_one")], F.explode(F.when(F.col("_one"), F.array("_p")).otherwise(F.array(F.col("_p"), F.struct(F.col("_p.v").alias("u"), F.col("_p.u").alias("v"))))).alias("_p")).select("*", "_p.*").drop("_p")
    at = lambda s: nodes.select(F.col("node_id").alias(s), F.col("x").alias(f"_{s}x"), F.col("y").alias(f"_{s}y"))
    out = both.join(at("u"), "u").join(at("v"), "v")
    distance = ellipsoid_distance if ellipsoid else G.sphere_distance
    key = F.row_number().over(Window.partitionBy("u", "v").orderBy("osmid")).cast("long") - 1
    return out.withColumn("length", distance(F.col("_ux"), F.col("_uy"), F.col("_vx"), F.col("_vy"))).drop("_ux", "_uy", "_vx", "_vy").withColumn("key", key)


def extract(ways: DataFrame, nodes: DataFrame, region: Column, major_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ways of the road types of an extract that have a node in the region, complete, and the nodes that they use."""
    kinds = MAJOR_HIGHWAYS + ([] if major_only else MINOR_HIGHWAYS)
    inside = nodes.where(G.in_polygon(F.col("x"), F.col("y"), region, boundary=True)).select("node_id")
    roads = ways.where(F.col("highway").isin(kinds))
    hit = roads.select("osmid", F.explode("node_ids").alias("node_id")).join(inside, "node_id", "left_semi").select("osmid").distinct()
    kept = roads.join(hit, "osmid", "left_semi")
    return kept, nodes.join(kept.select(F.explode("node_ids").alias("node_id")).distinct(), "node_id", "left_semi")


def floodplains(df: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Hazard polygons (``polygon, fld_zone, zone_subty``) whose bounds meet a box, with their index and risk level; unknown zones are an error."""
    if box:
        b = G.bounds(F.col("polygon")[0])
        df = df.where((b["min_x"] <= box[2]) & (b["max_x"] >= box[0]) & (b["min_y"] <= box[3]) & (b["max_y"] >= box[1]))
    out = df if "floodplain_idx" in df.columns else df.withColumn("floodplain_idx", F.monotonically_increasing_id())
    return require_ranks(out)


def inventory(df: DataFrame, county_geoid: str | None = None, where: tuple[str, ...] = ()) -> DataFrame:
    """Current records (``to_date`` null) of a county that meet further conditions; an unknown county is an error."""
    out = df.where("to_date IS NULL")
    if county_geoid:
        out = out.where(F.col("county") == county_code(F.lit(county_geoid)))
    for condition in where:
        out = out.where(condition)
    return out


def content_key(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:32]


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table written under a content key, built on first use; an unfinished write is not taken for one."""
    path = f"{folder}/{key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
