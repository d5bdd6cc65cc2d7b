"""Sinks: layers, fused tables, CSV with quoted text only, JDBC, polygon filter files, data dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfault.operators.validation import require_foreign_key, require_key

EDGE = ["u", "v", "key"]


def write_layers(layers: dict[str, DataFrame], folder: str, mode: str = "overwrite", read_only: bool = False) -> None:
    """A Parquet folder per layer; each is replaced as a whole (or, with ``mode="append"``, added to), and a failed write leaves no partial layer.

    ``read_only``: the files may not be written afterwards; replacing a layer as a whole remains possible.
    """
    for name, df in layers.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
        if read_only:
            protect(df.sparkSession, f"{folder}/{name}")


def protect(spark: SparkSession, folder: str) -> None:
    """Take the right to write from the files of a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    while files.hasNext():
        fs.setPermission(files.next().getPath(), hadoop.permission.FsPermission("444"))


def read_layer(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def csv_lines(df: DataFrame) -> DataFrame:
    """``value``: lines of a CSV whose texts are quoted and whose numbers are not; nulls are empty."""
    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("string")), F.lit(""))
        text = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))

    return df.select(F.concat_ws(",", *[cell(*c) for c in df.dtypes]).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts; the header, as quoted names, is a file beside them."""
    csv_lines(df).write.mode("overwrite").text(path)
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-header")


def load_tables(roadways: DataFrame, detours: DataFrame, base_paths: DataFrame, detour_paths: DataFrame, write) -> None:
    """Check keys and references of the four redundancy tables, then hand each, clustered by its key, to ``write(name, df)``."""
    require_key(roadways, EDGE)
    require_foreign_key(require_key(detours, EDGE), roadways, EDGE)
    parent = roadways.select(*[F.col(c).alias(f"path_{c}") for c in EDGE])
    for paths in (base_paths, detour_paths):
        require_foreign_key(require_key(paths, [*EDGE, "path_edge_index"]), parent, [f"path_{c}" for c in EDGE])
    for name, df, keys in (("roadways", roadways, EDGE), ("detours_info", detours, EDGE), ("base_paths", base_paths, [*EDGE, "path_edge_index"]), ("detour_paths", detour_paths, [*EDGE, "path_edge_index"])):
        write(name, df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def jdbc_writer(url: str, schema: str, properties: dict[str, str]):
    """A ``write`` for ``load_tables`` into a database."""
    return lambda name, df: df.write.mode("overwrite").jdbc(url, f"{schema}.{name}", properties=properties)


def views(spark: SparkSession, roadways: DataFrame, detours: DataFrame, base_paths: DataFrame, detour_paths: DataFrame, nodes: DataFrame) -> list[str]:
    """Temporary views: geometries of detours and paths, and of origins and destinations."""
    from wayfault.operators.paths import path_geometries

    point = F.struct("x", "y").alias("point")
    made = {
        "detour_info_geoms": detours.join(roadways.select(*EDGE, *[c for c in roadways.columns if c not in detours.columns]), EDGE),
        "base_path_geoms": path_geometries(base_paths, roadways), "detour_path_geoms": path_geometries(detour_paths, roadways),
        "origin_geoms": detours.join(nodes, F.col("origin") == F.col("node_id")).select(*EDGE, "origin", point),
        "destination_geoms": detours.join(nodes, F.col("destination") == F.col("node_id")).select(*EDGE, "destination", point),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)


def polygon_filter_lines(regions: DataFrame, name: str = "polygon") -> DataFrame:
    """``value``: lines of a polygon filter file: name, each ring (holes marked) with its points, END."""
    rings = regions.select(F.monotonically_increasing_id().alias("p"), F.posexplode("polygon").alias("r", "ring"))
    label = F.concat(F.when(F.col("r") > 0, "!").otherwise(""), (F.col("p") + 1).cast("string"), F.lit("_"), (F.col("r") + 1).cast("string"))
    number = lambda c: F.format_string("%.7E", c)
    body = F.transform("ring", lambda q: F.concat(F.lit("   "), number(q["x"]), F.lit("   "), number(q["y"])))
    lines = rings.select("p", "r", F.explode(F.concat(F.array(label), body, F.array(F.lit("END")))).alias("value"))
    spark = regions.sparkSession
    head, foot = spark.createDataFrame([(name,)], "value string"), spark.createDataFrame([("END",)], "value string")
    return head.union(lines.select("value")).union(foot)


def data_dictionary(df: DataFrame) -> DataFrame:
    """``column, type, description`` from the schema; descriptions are the fields' comments."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, description string")


def described(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """``df`` with comments on its columns."""
    for name, text in comments.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df
